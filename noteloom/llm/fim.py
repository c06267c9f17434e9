r"""Fill-in-the-middle: each text is cut at two token bounds into prefix, middle and suffix, which are put in another order.

Tokens are the isolated matches of a pattern in the tokenizers library's Split pre-tokenizer, which is not trained and
gives each match's code-point offsets. The bounds of a text are 0 and the ends of its tokens: their number less one is
n, and the ranks h1 % (n+1) and h2 % (n+1) pick the two cuts among them. h1 to h4 are the first groups of eight digits
of the hex sha256 of "<seed>:<doc_id>", so a document is cut alike in every run and on every executor.

Cuts come from Python in Arrow batches; slices, joins and digests are column functions. A long text goes through the
pre-tokenizer in blocks that end where a word ends, since no token crosses such a place: memory is in proportion to the
longest token and the text itself.

Null text counts as empty, null doc_id as an empty number. An empty text has no token and stays plain, as does a text
that holds one of the marks, so that what was cut can be put together again. Repeated rows stay, equal rows are cut
alike. Empty tables give none; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from .base import arrow_limits

TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: The first white space after a word: a token ends before it, whatever follows.
_SEAM = re.compile(r"(?<=[^\x20\x09-\x0D])[\x20\x09-\x0D]")
MARKS = ("<P>", "<S>", "<M>")


def bounds(text: str, splitter, block: int = 1 << 18) -> np.ndarray:
    """0 and the end of every token, in code points."""
    parts, at = [np.zeros(1, np.int64)], 0
    while at < len(text):
        seam = _SEAM.search(text, at + block)
        end = seam.start() if seam else len(text)
        tokens = splitter.pre_tokenize_str(text[at:end])
        parts.append(np.fromiter((e for _, (_, e) in tokens), np.int64, len(tokens)) + at)
        at = end
    return np.concatenate(parts)


def _groups(doc_id: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, marks: tuple[str, str, str] = MARKS, pattern: str = TOKEN) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for each row of docs (doc_id, text).

    rate: per cent of texts to cut, spm_rate: per cent of those with the suffix first (form spm, else psm). A pattern
    must end its tokens where white space follows a word, as TOKEN does.
    """

    def cuts(texts: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
        splitter = pre_tokenizers.Split(Regex(pattern), "isolated")
        rows = []
        for text, *h in zip(texts, first, second, strict=True):
            ends = bounds(text, splitter)
            a, b = sorted(x % len(ends) for x in h)
            rows.append((len(ends) - 1, ends[a], ends[b]))
        return pd.DataFrame(rows, columns=["n", "a", "b"], dtype="int64")

    arrow_limits(docs.sparkSession)
    text, p, s, m = F.col("text"), *map(F.lit, marks)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashed = rows.select("*", *[h.alias(f"h{i}") for i, h in enumerate(_groups(F.col("doc_id"), seed), 1)])
    cut = hashed.withColumn("c", F.pandas_udf(cuts, "n long, a long, b long")("text", "h1", "h2"))
    plain = reduce(Column.__or__, [F.contains(text, x) for x in (p, s, m)], (text == "") | (F.col("h3") % 100 >= rate))
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    a, b = F.col("c.a").cast("int"), F.col("c.b").cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a), F.substring(text, b + 1, F.length(text))
    output = F.when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(text)
    size = lambda x: F.when(F.col("form") != "plain", x)
    return cut.withColumn("form", form).select("doc_id", F.col("c.n").alias("n"), "form", size(F.col("c.a")).alias("prefix_chars"), size(F.col("c.b") - F.col("c.a")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that transform() has cut. Texts that are cut hold no mark, so a split at the marks gives the parts."""
    part = F.split(output, "|".join(map(re.escape, marks)), -1).getItem
    return F.when(form == "spm", F.concat(part(2), part(3), part(1))).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(output)


def digests(cut: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """transform()'s rows with digests in place of the texts: of the output, and of the text put together from it."""
    back = restored(F.col("output"), F.col("form"), marks)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


#: The same rows in DuckDB.
ORACLE = r"""
WITH h AS (
  SELECT doc_id, COALESCE(text, '') AS text, sha256('42:' || COALESCE(doc_id::VARCHAR, '')) AS d,
    regexp_extract_all(COALESCE(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t FROM documents
), r AS (
  SELECT *, len(t)::BIGINT AS n, ('0x' || d[1:8])::BIGINT % (len(t) + 1) AS x, ('0x' || d[9:16])::BIGINT % (len(t) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || d[17:24])::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || d[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h
), s AS (
  SELECT *, array_to_string(t[1:least(x, y)], '') AS p, array_to_string(t[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(t[greatest(x, y) + 1:], '') AS e FROM r
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || e || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || e || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM s
"""
