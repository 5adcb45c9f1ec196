"""Registered queries of the engine, each with the SQL that it is held against."""
