"""Pieces of long texts, cut at natural boundaries, each beginning with the end of the one before.

One regular expression takes a text apart: its alternatives are ordered by strength of boundary
(rest of the text, paragraph, sentence or line, word, and at last any character) and each consumes
as much as a piece may hold, by bounded quantifiers. Array functions then put before each piece a
lookback into the one before, from the first word that begins within the overlap. The work of a
text is linear in its length, and everything runs in the JVM, row by row, without a shuffle.

Defined cases: a text of at most ``limit`` characters is one piece; null and empty texts give none; characters are
code points as stored; a cut never parts a base letter from its combining marks or CR from LF where
another place is left; without any boundary it is cut by length. Joining the pieces without their overlap gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1200, 150


def cut_pattern(room: int) -> str:
    """The expression that takes ``room`` characters at most."""
    any_, half = "[\\s\\S]", max(1, room // 2)
    whole = r"(?!\p{M})(?!(?<=\r)\n)"
    paragraph = r"(?<=(?:\r\n|[\r\n\u2028\u2029])[ \t]{0,4}(?:\r\n|[\r\n\u2028\u2029]))(?![\r\n])|(?<=\u2029)"
    sentence = r"""(?<=[.!?…][\"'”’»)\]]{0,3}\s)(?!\s)|(?<=[。！？।؟])(?![。！？”’」』）])|(?<=[\r\n\u2028])(?![\r\n])"""
    word = r"(?<=\s)(?!\s)|(?=\s)"
    return "|".join([
        rf"{any_}{{1,{room}}}\z",
        rf"{any_}{{{half},{room}}}(?:{paragraph})",
        rf"{any_}{{{half},{room}}}(?:{sentence})",
        rf"{any_}{{1,{room}}}(?:{word})",
        rf"{any_}{{1,{room}}}{whole}",
        rf"{any_}{{1,{room}}}",
    ])


def split_texts(rows: DataFrame, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``rows`` without ``text``, one for each piece, with piece_no from 0, n_pieces, overlap_chars and piece.

    Columns of ``rows`` with the names of the added ones are left out.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    kept = [c for c in rows.columns if c not in {text, "piece_no", "n_pieces", "overlap_chars", "piece"}]
    t = F.col(text)
    bodies = F.when(F.length(t) > limit, F.regexp_extract_all(t, F.lit(cut_pattern(limit - overlap)), F.lit(0))).when(F.length(t) > 0, F.array(t))
    cut = rows.select(*kept, bodies.alias("_bodies"))

    def lookback(body: Column, i: Column) -> Column:
        tail = F.right(F.get("_bodies", i - 1), F.lit(overlap))
        # from the first word that begins within the lookback; all of it where the body before is no longer
        return F.when((i == 0) | F.lit(overlap == 0), F.lit("")).when(F.length(tail) < overlap, tail).otherwise(F.regexp_replace(tail, r"^(?s:\S+\s+)(?=\S)", ""))

    pieces = F.transform("_bodies", lambda body, i: F.struct(lookback(body, i).alias("overlap"), body.alias("body")))
    out = cut.select(*kept, F.size("_bodies").alias("n_pieces"), F.posexplode(pieces).alias("piece_no", "_p"))
    return out.select(*kept, "piece_no", "n_pieces", F.length("_p.overlap").alias("overlap_chars"), F.concat("_p.overlap", "_p.body").alias("piece"))
