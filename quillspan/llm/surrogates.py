"""PII surrogates: entities become keyed, type-consistent replacements.

Detected: e-mail addresses, phone numbers, payment cards (Luhn), IPv4 addresses, secrets (values behind password,
token and the like in any case, with = or :, spaces and quotes as they come; well-known key forms), names behind a title and all other whole-word mentions of those names in the document. A surrogate keeps its original's type and format:
length, punctuation, case, script of letters, Luhn validity, the class of an address, and for listed
first names the gender. It is made by a keyed permutation (a Feistel network over the entity's own
alphabet and length), so distinct entities of a format get distinct surrogates, and one entity gets the
same surrogate in every document and in every task, without any shuffle.

Collision checks: a surrogate must differ from its original, from every entity that the document really
has and from the surrogates of the document's other entities. If not, the entity takes the permutation
of its next round in that document; after every ROUNDS of them it goes on in a larger space (letters for
listed names, then longer words and numbers), so a document can't use up a format. `collisions` lists what still clashes over a whole corpus.

Defined results: null text stays null, empty text empty, both without entities. Whole texts are read.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import id_in, id_out

TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|M\\.|Sr|Sra|Señor|Señora"
#: Words in front of a secret, in any case, and secrets that their own beginning gives away.
KEYWORDS, KEY_HEADS = r"passw(?:or)?d|secret|token|api[_-]?key", r"AKIA|gh[pousr]_|sk-"
EMAIL = r"[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PATTERN = re.compile(
    rf"(?P<EMAIL>(?<![\w.+-]){EMAIL})"
    rf"|(?i:{KEYWORDS})[\"']?\s*[=:]\s*[\"']?(?!{EMAIL})(?P<SECRET>[A-Za-z0-9_\-+/]{{8,}}={{0,2}})"
    r"|(?P<KEY>\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,}))"
    r"|(?P<IP>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d))"
    r"|(?P<PHONE>(?<![\w.])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d))"
    r"|(?P<CARD>(?<![\d.-])\d(?:[ -]?\d){12,18}(?!\d))"
    rf"|(?P<NAME>(?<=\b)(?:{TITLES})\.? (?P<GIVEN>[^\W\d_][\w'-]+)(?: (?P<FAMILY>[^\W\d_][\w'-]+))?)"
)
#: A text without any of these can't hold an entity.
QUICK = re.compile(rf"[@\d]|{TITLES}|(?i:{KEYWORDS})|{KEY_HEADS}")
#: First names by gender.
FEMALE = "Alice Anna Carmen Claire Elena Emma Eva Greta Hannah Ines Julia Laura Lena Lucia Maria Marie Olivia Paula Sarah Sofia".split()
MALE = "Adam Carlos Daniel David Felix Hans Hugo Jack James John Jonas Karl Louis Lucas Martin Max Paul Pedro Peter Thomas".split()
GENDER = {n: g for g, names in (("f", FEMALE), ("m", MALE)) for n in names}
#: Rounds in one space of surrogates.
ROUNDS = 64
_WORDS = re.compile(r"\w[\w'-]*")
_TITLE = re.compile(TITLES)
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


SCRIPTS = (DIGITS, LOWER, UPPER, "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœšžß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒŠŽ", "".join(map(chr, range(0x3B1, 0x3CA))), "".join(map(chr, [*range(0x391, 0x3A2), *range(0x3A3, 0x3AA)])), "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x410, 0x430))), "".join(map(chr, range(0x4E00, 0x9FA6))))


def permute(key: bytes, tweak: str, x: int, n: int) -> int:
    """A keyed permutation of range(n): an eight-round Feistel network on an even number of bits, walked until in range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, size = (1 << half) - 1, half // 8 + 8
    while True:
        a, b = x >> half, x & mask
        for r in range(8):
            # SHAKE gives as many bits as the half needs, however long the entity
            a, b = b, a ^ (int.from_bytes(hashlib.shake_128(key + f"|{tweak}|{n}|{r}|{b:x}".encode()).digest(size), "big") & mask)
        x = (a << half) | b
        if x < n:
            return x


def alphabet_of(c: str) -> str | None:
    return next((a for a in SCRIPTS if c in a), None)


def spelled(key: bytes, tweak: str, text: str, alphabets: list[str | None]) -> str:
    """text with the characters of its alphabets' places permuted as one mixed-radix number; others stay."""
    x, n = 0, 1
    for c, a in zip(text, alphabets, strict=True):
        if a:
            x, n = x * len(a) + a.index(c), n * len(a)
    shape = "".join(a[0] if a else c for c, a in zip(text, alphabets, strict=True))
    y = permute(key, f"{tweak}|{shape}", x, n)
    out = []
    for c, a in zip(reversed(text), reversed(alphabets), strict=True):
        if a:
            y, k = divmod(y, len(a))
            c = a[k]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """Sum that a valid number has as a multiple of ten."""
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))


def refilled(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def ip_class(x: int) -> str:
    a, b = x >> 24, x >> 16 & 255
    if a == 10 or a == 172 and 16 <= b < 32 or a == 192 and b == 168:
        return f"private{a}"
    return "loopback" if a == 127 else "other" if a in (0, 169) or a >= 224 else "public"


def entity_of(kind: str, text: str) -> str:
    """What makes two mentions one entity: letters' case in addresses and the separators of numbers don't count."""
    if kind == "EMAIL":
        return text.lower()
    if kind in ("PHONE", "CARD"):
        return re.sub(r"\D", "", text)
    return text


def surrogate(kind: str, text: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of an entity's mention, in its format. kind NAME: one word of a name."""
    tweak = f"{kind}|{attempt}"
    larger = attempt // ROUNDS
    if larger and kind in ("EMAIL", "SECRET", "PHONE") or larger > 1 and kind == "NAME":
        more = larger - (kind == "NAME")
        text = "a" * more + text if kind == "EMAIL" else text + ("0" if kind == "PHONE" else "a") * more
    if kind == "EMAIL":
        low = text.lower()
        stay = low.rindex(".")
        new = spelled(key, tweak, low, [alphabet_of(c) if k < stay else None for k, c in enumerate(low)])
        return "".join(n.upper() if o.isupper() and len(n.upper()) == 1 else n for o, n in zip(text, new, strict=True))
    if kind == "PHONE":
        digits = re.sub(r"\D", "", text)
        country = len(re.match(r"\+(\d{1,3})", text)[1])
        return refilled(text, spelled(key, tweak, digits, [None if k < country else DIGITS for k in range(len(digits))]))
    if kind == "CARD":
        digits = re.sub(r"\D", "", text)
        if luhn(digits) % 10:
            return refilled(text, spelled(key, tweak, digits, [None] + [DIGITS] * (len(digits) - 1)))
        body = spelled(key, tweak, digits[:-1], [None] + [DIGITS] * (len(digits) - 2))
        return refilled(text, body + str(-luhn(body + "0") % 10))
    if kind == "IP":
        x = 0
        for part in text.split("."):
            x = x * 256 + int(part)
        y = permute(key, tweak, x, 1 << 32)
        # the largest private block stands in for a smaller one that is used up
        wanted = "private10" if larger and ip_class(x).startswith("private") else ip_class(x)
        while ip_class(y) != wanted:
            y = permute(key, tweak, y, 1 << 32)
        return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))
    if kind == "SECRET":
        if all(c in HEX for c in text):
            return spelled(key, tweak, text, [HEX] * len(text))
        head = re.match(rf"{KEY_HEADS}|", text).end()
        return spelled(key, tweak, text, [alphabet_of(c) if k >= head else None for k, c in enumerate(text)])
    if text in GENDER and not larger:
        names = FEMALE if GENDER[text] == "f" else MALE
        return names[permute(key, tweak + GENDER[text], names.index(text), len(names))]
    return spelled(key, tweak, text, [alphabet_of(c) for c in text])


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, type) of the mentions in order; a name's words are mentions of their own, its title stays. Words of names
    (those without a small initial) count wherever they stand outside other mentions."""
    if not text or not QUICK.search(text):
        return []
    out: list[tuple[int, int, str]] = []
    names: set[str] = set()
    for m in PATTERN.finditer(text):
        if m.lastgroup == "NAME" or m["NAME"]:
            for a, z in (m.span(g) for g in ("GIVEN", "FAMILY") if m[g]):
                # a possessive's ending and outer marks are not the name's
                bare = re.sub(r"('s)?['-]*$", "", text[a:z])
                out.append((a, a + len(bare), "NAME"))
                if not bare[0].islower() and not _TITLE.fullmatch(bare):
                    names.add(bare)
        else:
            out.append((*m.span(m.lastgroup), "SECRET" if m.lastgroup == "KEY" else m.lastgroup))
    return sorted(out + _again(text, names, out)) if names else out


def _again(text: str, names: set[str], found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Whole-word mentions of names outside the found mentions."""
    starts = [a for a, _, _ in found]
    out = []
    for m in _WORDS.finditer(text):
        # a hyphened or possessive word can be a name as a whole or hold one
        for w in [m] if m[0] in names else re.compile(r"\w+").finditer(text, *m.span()):
            if w[0] in names:
                k = bisect.bisect_left(starts, w.end())
                if not k or found[k - 1][1] <= w.start():
                    out.append((*w.span(), "NAME"))
    return out


def replaced(text: str | None, key: bytes) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and each mention: type, start and end in the new text, digest of the entity, surrogate."""
    found = entities(text)
    if not found:
        return text, []
    real = {(kind, entity_of(kind, text[a:z])) for a, z, kind in found}
    chosen: dict[tuple[str, str], int] = {}
    taken: set[tuple[str, str]] = set()
    parts, spans, at, size = [], [], 0, 0
    for a, z, kind in found:
        e = (kind, entity_of(kind, text[a:z]))
        if e not in chosen:
            k = 0
            while (kind, entity_of(kind, surrogate(kind, text[a:z], key, k))) in real | taken:
                k += 1
            chosen[e] = k
            taken.add((kind, entity_of(kind, surrogate(kind, text[a:z], key, k))))
        new = surrogate(kind, text[a:z], key, chosen[e])
        parts += [text[at:a], new]
        size += a - at
        spans.append({"type": kind, "start": size, "end": size + len(new), "entity": hmac.new(key, "|".join(e).encode(), hashlib.sha256).hexdigest()[:24], "surrogate": new})
        size += len(new)
        at = z
    return "".join([*parts, text[at:]]), spans


def with_surrogates(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, text (with surrogates), n_entities, spans (in the new text). One pass, no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(t, len(s), s) for t, s in (replaced(t, key) for t in f["text"])]
            yield pd.concat([f[["id"]], pd.DataFrame(rows, columns=["text", "n_entities", "spans"], index=f.index)], axis=1)

    rows = docs.select(id_in(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInPandas(run, "id long, text string, n_entities int, spans array<struct<type:string,start:int,end:int,entity:string,surrogate:string>>")
    return out.withColumn("id", id_out()).withColumnRenamed("id", id_col)


def collisions(replaced_docs: DataFrame) -> DataFrame:
    """Surrogates that stand for several entities: type, surrogate, n_entities. Counting pre-aggregates by both."""
    mentions = replaced_docs.select(F.explode("spans").alias("s")).select("s.type", F.when(F.col("s.type") == "EMAIL", F.lower("s.surrogate")).when(F.col("s.type").isin("PHONE", "CARD"), F.regexp_replace("s.surrogate", r"\D", "")).otherwise(F.col("s.surrogate")).alias("surrogate"), "s.entity")
    return mentions.distinct().groupBy("type", "surrogate").agg(F.count(F.lit(1)).alias("n_entities")).filter("n_entities > 1")
