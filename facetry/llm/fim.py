"""Fill-in-middle: texts cut into units at zero-width boundaries and put together in another order.

A grammar names the pairs of character classes between which one unit ends and the next begins. It becomes a regex of
lookarounds that matches no character, so Spark's split keeps every character of the text in one of its pieces, and the
pieces joined are the text. Empty text has no neighbouring characters and no pieces; it is handled apart (split would give
one empty piece).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, read

_ANY, _SPACE, _SOLID = r"\s\S", r"\x20\t-\r", r"^\x20\t-\r"
#: Unit grammars: (class before the boundary, class after it), as bodies of character classes.
GRAMMARS = {
    "codepoint": [(_ANY, _ANY)],
    "word": [(_SPACE, _SOLID)],  # a word with the white space after it
    "line": [(r"\n", _ANY)],  # a line with its \n
    "sentence": [(r".!?。！？", _SPACE)],  # up to a closing mark that white space follows, which begins the next unit
    "run": [(r"\p{L}", r"^\p{L}"), (r"^\p{L}", r"\p{L}"), (r"\d", r"^\d"), (r"^\d", r"\d"), (_SPACE, _SOLID), (_SOLID, _SPACE)],  # runs of letters, digits, white space, others
}
#: The markers before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Per cent of the texts without markers that are cut, and of those the per cent with the suffix first.
CUT, SUFFIX_FIRST = 90, 20


def boundary(grammar: str | list[tuple[str, str]]) -> str:
    """The regex that matches between two units and nowhere else: never at the ends of a text, never inside a code point."""
    return "|".join(f"(?<=[{a}])(?=[{b}])" for a, b in (GRAMMARS[grammar] if isinstance(grammar, str) else grammar))


def units(text: Column, grammar: str | list[tuple[str, str]] = "codepoint") -> Column:
    """The units of a text in order; none for null and empty text."""
    return F.when(F.length(text) > 0, F.split(text, boundary(grammar), -1)).otherwise(F.array().cast("array<string>"))


def draw(salt: str | Column, doc_id: str | Column, k: int) -> Column:
    """The k-th (0 to 7) 32-bit number that a text's id draws; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(salt) if isinstance(salt, str) else salt, F.lit(":"), id_text(doc_id)).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _joined(units: Column, start: Column, count: Column) -> Column:
    return F.array_join(F.slice(units, (start + 1).cast("int"), count.cast("int")), "")


def infill(docs: DataFrame, grammar: str | list[tuple[str, str]] = "codepoint", salt: str = "1", marks: tuple[str, str, str] = MARKS, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix, middle and suffix (null if plain) and output.

    Two numbers of the doc_id give the ends of prefix and middle, uniform over the n + 1 boundaries. Null text is empty; empty
    texts and texts with a marker are plain and their output is the text (empty for null). Rows that share a doc_id are cut by
    the same numbers, repeated rows get equal results, a null doc_id draws as an empty one, and no two rows meet, so ties do not
    occur. A text's pieces lie in one task's memory, some 60 bytes a unit, so a very long text costs as much as
    its units; nothing is cut off. Columns of docs with the names of results are replaced; an empty table gives no rows.
    """
    made = ("n", "form", "prefix", "middle", "suffix", "output")
    own = [F.col(c) for c in docs.columns if c not in made]
    p, s, m = (F.lit(x) for x in marks)
    plain = (F.col("·text") == "") | F.greatest(*(F.contains("·text", x) for x in (p, s, m))) | (draw(salt, "doc_id", 2) % 100 >= cut)
    form = F.when(plain, "plain").when(draw(salt, "doc_id", 3) % 100 < suffix_first, "spm").otherwise("psm")
    d = docs.select(*own, F.coalesce("text", F.lit("")).alias("·text")).withColumn("form", form)
    d = d.withColumn("·units", units(F.col("·text"), grammar)).withColumn("n", F.size("·units").cast("long"))
    d = d.withColumns({"·1": draw(salt, "doc_id", 0) % (F.col("n") + 1), "·2": draw(salt, "doc_id", 1) % (F.col("n") + 1)})
    a, b, cuts = F.least("·1", "·2"), F.greatest("·1", "·2"), F.col("form") != "plain"
    parts = {"prefix": (F.lit(0), a), "middle": (a, b - a), "suffix": (b, F.col("n") - b)}
    d = d.select(*own, "·text", "n", "form", *(F.when(cuts, _joined(F.col("·units"), *x)).alias(k) for k, x in parts.items()))
    output = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle")).otherwise(F.col("·text"))
    return d.select(*own, *made[:5], output.alias("output"))


def restore(output: str | Column, form: str | Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from an output and its form alone. Markers begin with a character that occurs in them once, so that no other
    place of a cut text can look like one; null output or form gives null."""
    o, f = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    pieces = F.split(o, "|".join(rf"\Q{x}\E" for x in marks), -1)  # nothing, then the three parts in the order of the form
    back = lambda *k: F.concat(*(F.get(pieces, F.lit(i)) for i in k))
    return F.when(f == "psm", back(1, 3, 2)).when(f == "spm", back(2, 3, 1)).when(f == "plain", o)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = infill(read(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return d.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), sha(F.col("output")).alias("output_sha256"), sha(restore("output", "form")).alias("restored_sha256"))


#: DuckDB's form over `documents`.
SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (length(t) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (length(t) + 1) AS y,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS z, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS w FROM d),
f AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR z >= 90 THEN 'plain' WHEN w < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
c AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM c
"""
