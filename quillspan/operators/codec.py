"""Inline tags and model output: <pii type="...">value</pii> to spans and back, JSON out of generated text."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"""<pii\s+type=(?:"([^"]*)"|'([^']*)'|([^\s>]+))\s*>|</pii\s*>""", re.IGNORECASE)
THINK = re.compile(r"<think>.*?</think>", re.DOTALL | re.IGNORECASE)


def parse_tags(raw: str | None) -> tuple[str, list[dict], list[str]]:
    """(text without tags, spans, warnings). Entities are unescaped part by part, so offsets are of the final text; nested tags
    give a span each; a tag that never closes gives none."""
    text, size, at, stack, spans, warnings = [], 0, 0, [], [], []
    raw = THINK.sub("", raw or "")
    for m in TAG.finditer(raw):
        piece = html.unescape(raw[at : m.start()])
        text.append(piece)
        size += len(piece)
        at = m.end()
        if m[0][1] != "/":
            stack.append((next((g for g in m.groups() if g is not None), "").strip().upper(), size))
        elif stack:
            kind, start = stack.pop()
            spans.append({"start": start, "end": size, "type": kind})
        else:
            warnings.append("closing_without_opening")
    text.append(html.unescape(raw[at:]))
    out = "".join(text)
    warnings += ["unclosed"] * len(stack)
    for s in spans:
        s["value"] = out[s["start"] : s["end"]]
    return out, sorted((s for s in spans if s["value"]), key=lambda s: (s["start"], -s["end"])), warnings


def parsed(df: DataFrame, id_col: str, raw_col: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.concat([f[["id"]], pd.DataFrame([parse_tags(r) for r in f["raw"]], columns=["text", "spans", "warnings"], index=f.index)], axis=1)

    rows = df.select(F.col(id_col).alias("id"), F.col(raw_col).alias("raw"))
    return rows.mapInPandas(run, "id long, text string, spans array<struct<start:int,end:int,type:string,value:string>>, warnings array<string>")


def tagged(text: Column, spans: Column) -> Column:
    """text with its spans (no overlaps) in tags; the spans may come in any order."""
    order = F.array_sort(spans, lambda a, b: (a["start"] - b["start"]).cast("int"))
    out = F.aggregate(
        order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(s["end"].cast("int").alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit('<pii type="'), s["type"], F.lit('">'), F.substring(text, s["start"] + 1, s["end"] - s["start"]), F.lit("</pii>")).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return out


def generated_json(raw: str | None) -> str | None:
    """The JSON object in generated text: fences and thoughts removed, the first balanced braces; a list of objects that
    breaks off is closed after its last whole object. Null if none."""
    raw = re.sub(r"```(?:json)?", "", THINK.sub("", raw or ""))
    begin = raw.find("{")
    if begin < 0:
        return None
    try:
        value, _ = json.JSONDecoder().raw_decode(raw[begin:])
        return json.dumps(value, ensure_ascii=False)
    except ValueError:
        for cut in reversed([m.end() for m in re.finditer(r"\}", raw[begin:])]):
            for close in ("]}", "}", "]}}"):
                try:
                    return json.dumps(json.loads(raw[begin : begin + cut] + close), ensure_ascii=False)
                except ValueError:
                    continue
    return None
