r"""Spelling variants: every word's neighbours at one edit, found by automata over tries, and the form it is a variant of.

Words are counted by Spark. The vocabulary is cut into shards of sorted keys, each a compact trie (children as one
string of labels, targets and key offsets as arrays, single keys below a node as leaves), built by executors. Shards are
broadcast in rounds of at most `round_bytes`, whatever the size of the vocabulary. A task walks each of its words'
distance-one Levenshtein automaton and a trie together, depth first: where a key leaves the word, the edit is spent on an
inserted, replaced or skipped code point, and the rest must follow the word. A key where both accept is a neighbour.

At most one edit leaves the first or the second half of a word as it is. So there are shards of words and shards of
reversed words: a walk in the first kind spends its edit behind the word's first half, one in the second kind finds the
keys that differ within the first half. Either enters a shard only below an exact prefix, so that shards which can't hold
a neighbour are left at their bounds, and the work grows with the vocabulary and not with its square. Each neighbour is
found by exactly one of the two. Sums and best neighbours of the shards meet in one aggregation.

Null text has no words, null doc_id is an empty number. Repeated rows count each. Ties of n go to the smallest word in
code-point order. Empty tables give none. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, keep, lower_ascii

LEAST = 6
#: Behind every letter of a word.
_END = "\U0010ffff"


class Trie:
    """A compact trie of sorted keys, which all have a count.

    Nodes are prefixes that two keys share. labels[start[v]:start[v + 1]] are the first letters below node v, targets
    their nodes, or ~i for key i where only that key goes on. own[v] is the key that ends at v, or -1.
    """

    def __init__(self, keys: list[str], counts: list[int]):
        self.text, self.counts = "".join(keys), array("q", counts)
        self.offsets = array("I", np.cumsum([0, *map(len, keys)]).tolist())
        common = [0, *map(_common, keys, keys[1:]), 0]
        edges, own, path = [], [-1], [0]
        for i, key in enumerate(keys):
            shared = max(common[i], common[i + 1])
            del path[common[i] + 1 :]
            for at in range(common[i], shared):
                edges.append((path[-1], key[at], len(own)))
                path.append(len(own))
                own.append(-1)
            if shared == len(key):
                own[path[-1]] = i
            else:
                edges.append((path[-1], key[shared], ~i))
        edges.sort()
        self.own, self.labels, self.targets = array("i", own), "".join(e[1] for e in edges), array("i", [e[2] for e in edges])
        degree = np.bincount([e[0] for e in edges], minlength=len(own)) if edges else np.zeros(len(own), np.int64)
        self.start = array("I", np.concatenate([[0], np.cumsum(degree)]).tolist())

    def key(self, i: int) -> str:
        return self.text[self.offsets[i] : self.offsets[i + 1]]

    def follow(self, node: int, word: str, at: int, to: int) -> int | None:
        """The node or leaf (~i) that word[at:to] leads to from node; a leaf as soon as only one key is left."""
        for i in range(at, to):
            j = self.labels.find(word[i], self.start[node], self.start[node + 1])
            if j < 0:
                return None
            node = self.targets[j]
            if node < 0:
                return node
        return node

    def near(self, word: str, prefix: int) -> set[int]:
        """Keys at exactly one edit from word that begin with word[:prefix]."""
        found, size = set(), len(word)
        node = self.follow(0, word, 0, prefix)
        if node is None:
            return found

        def accept(at: int | None) -> None:
            """The word has been followed to its end from a place where the edit was spent."""
            if at is not None and (i := ~at if at < 0 else self.own[at]) >= 0:
                maybe(i)

        def maybe(i: int) -> None:
            if abs(self.offsets[i + 1] - self.offsets[i] - size) <= 1 and (key := self.key(i))[:prefix] == word[:prefix] and one_edit(word, key):
                found.add(i)

        at = prefix
        while node is not None and node >= 0:  # no edit is spent yet; it is, where a key leaves the word
            here = word[at : at + 1]
            for j in range(self.start[node], self.start[node + 1]):
                letter, below = self.labels[j], self.targets[j]
                if letter == here:
                    continue
                if below < 0:
                    maybe(~below)
                    continue
                accept(self.follow(below, word, at, size))  # a letter more
                if here:
                    accept(self.follow(below, word, at + 1, size))  # another letter
                if letter == word[at + 1 : at + 2]:
                    accept(self.follow(below, word, at + 2, size))  # a letter less
            if not here:
                return found
            if at + 1 == size:
                accept(node)  # the last letter less
            node = self.follow(node, word, at, at + 1)
            at += 1
        if node is not None:
            maybe(~node)
        return found


def _common(a: str, b: str) -> int:
    """How many letters both begin with."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:  # alike up to low, not up to high
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one insertion, deletion or replacement makes b of a."""
    i = _common(a, b)
    return len(a) == len(b) != i and a[i + 1 :] == b[i + 1 :] or len(a) + 1 == len(b) and a[i:] == b[i + 1 :] or len(a) == len(b) + 1 and a[i + 1 :] == b[i:]


def counted_words(docs: DataFrame, letters: str = r"a-zÀ-ÿ", least: int = LEAST, least_n: int = 5, every: int = 199) -> DataFrame:
    """word, n of the words of docs (doc_id, text); one run of letters in `every` loses a code point, by a checksum."""
    run, doc = F.col("run"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    runs = docs.select(doc.alias("doc"), F.explode(F.regexp_extract_all(lower_ascii(F.col("text").cast("string")), F.lit(f"[{letters}]{{{least},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    word = F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)
    return runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least_n) & (F.length("word") >= least))


def tries(keys: DataFrame, shard_words: int = 1 << 15, shard_chars: int = 1 << 20) -> DataFrame:
    """side, low, high (first and last key), size, trie: shards of the sorted keys (side, key, n)."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, counts, chars, side = [], [], 0, None

        def shard():
            data = pickle.dumps(Trie(words, counts).__dict__, 5)
            return pd.DataFrame([(side, words[0], words[-1], len(data), data)], columns=["side", "low", "high", "size", "trie"])

        for frame in frames:
            for s, key, n in zip(frame.side, frame.key, frame.n, strict=True):
                if words and (s != side or len(words) >= shard_words or chars >= shard_chars):
                    yield shard()
                    words, counts, chars = [], [], 0
                side = s
                words.append(key)
                counts.append(n)
                chars += len(key)
        if words:
            yield shard()

    return keys.mapInPandas(build, "side int, low string, high string, size long, trie binary")


def _searched(keys: DataFrame, sent: Broadcast) -> DataFrame:
    """word, n_near, best_n, best: what the shards sent hold near the words of keys, without words that have nothing."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides = []
        for side in (0, 1):
            own = sorted((x[1:] for x in sent.value if x[0] == side), key=lambda x: x[0])
            sides.append(([x[0] for x in own], [x[1] for x in own], [x[2] for x in own], {}))

        def opened(packed, cache, i):
            if i not in cache:
                cache.clear()  # keys come in order, so the shard before is done with
                cache[i] = Trie.__new__(Trie)
                cache[i].__dict__ = pickle.loads(packed[i])
            return cache[i]

        for frame in frames:
            rows = []
            for side, key in zip(frame.side, frame.key, strict=True):
                lows, highs, packed, cache = sides[side]
                word = key[::-1] if side else key
                half = len(word) // 2
                prefix = len(word) - half if side else half
                first, last = bisect_left(highs, key[:prefix]), bisect_right(lows, key[:prefix] + _END)
                n, best = 0, (0, "")
                for i in range(first, last):
                    trie = opened(packed, cache, i)
                    for k in trie.near(key, prefix):
                        other = trie.key(k)[::-1] if side else trie.key(k)
                        if side and other[:half] == word[:half]:
                            continue  # found in the words as they are
                        n += 1
                        c = trie.counts[k]
                        if c > best[0] or c == best[0] and other < best[1]:
                            best = (c, other)
                if n:
                    rows.append((word, n, *best))
            yield pd.DataFrame(rows, columns=["word", "n_near", "best_n", "best"])

    return keys.mapInPandas(search, "word string, n_near long, best_n long, best string")


def neighbours(words: DataFrame, shard_words: int = 1 << 15, round_bytes: int = 64 << 20) -> DataFrame:
    """word, n_near, best_n, best: number of words at one edit, and the one of largest n, for words (word, n) that have any."""
    parts = max(1, -(-2 * words.count() // shard_words))
    both = words.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("key"), "n"), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("key"), "n"))).alias("k")).select("k.*")
    ordered = both.repartitionByRange(parts, "side", "key").sortWithinPartitions("side", "key")
    keys, shards = keep(ordered, "keys"), keep(tries(ordered, shard_words), "tries")
    sizes = shards.select("side", "low", "high", "size").orderBy("side", "low").collect()  # one row a shard
    rounds, left = [], 0
    for r in sizes:
        if not rounds or r["size"] > left or rounds[-1][0]["side"] != r["side"]:
            rounds.append([])
            left = round_bytes
        rounds[-1].append(r)
        left -= r["size"]
    found = []
    for group in rounds:
        side, low, high = group[0]["side"], group[0]["low"], group[-1]["high"]
        here = shards.where((F.col("side") == side) & F.col("low").between(low, group[-1]["low"])).collect()  # at most round_bytes, or one shard
        sent = words.sparkSession.sparkContext.broadcast([(r["side"], r["low"], r["high"], bytes(r["trie"])) for r in here])
        half = F.floor(F.length("key") / 2).cast("int")
        prefix = F.substring("key", F.lit(1), F.length("key") - half if side else half)
        able = keys.where((F.col("side") == side) & (prefix <= high) & (F.concat(prefix, F.lit(_END)) >= low))
        found.append(keep(_searched(able, sent), "near"))
        sent.unpersist()
    if not found:
        return words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(0).cast("long").alias("best_n"), F.lit("").alias("best")).limit(0)
    discard(keys, shards)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    best = F.min_by(F.struct("best_n", "best"), F.struct(-F.col("best_n"), F.col("best")))
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.best_n").alias("best_n"), F.col("b.best").alias("best"))


def variants(words: DataFrame, times: int = 5, shard_words: int = 1 << 15, round_bytes: int = 64 << 20) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n), each once.

    form: the most frequent neighbour, if it is at least `times` as frequent. Along forms n grows by that factor, so
    chains end after few steps, and joining the links with themselves halves what is left of them.
    """
    words = keep(words, "words")
    judged = words.join(neighbours(words, shard_words, round_bytes), "word", "left")
    frequent = F.col("best_n") >= F.col("n") * times
    rows = keep(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best")).alias("form"), F.when(frequent, F.col("best_n")).alias("form_n")), "forms")
    links, moved = keep(rows.where("form is not null").select("word", F.col("form").alias("root")), "links"), True
    while moved:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = keep(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        moved = steps.where("moved").limit(1).count() > 0
        discard(links)
        links = steps
    return rows.join(links.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same rows in DuckDB, which has no checksum of its own: one step a byte, with the table of the reversed polynomial.
ORACLE = r"""
WITH RECURSIVE steps AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS crc FROM (SELECT unnest(range(256)) AS b)
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{6,}')) AS run FROM documents
), counted AS (
  SELECT run, hex(encode(doc_id || ':' || run)) AS bytes, count(*) AS n FROM runs GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(list_reduce(list_transform(range(1, length(bytes), 2), lambda i: ('0x' || bytes[i:i + 1])::BIGINT),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM counted, steps
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, SUM(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING SUM(n) >= 5 AND length(word) >= 6
), cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, COALESCE(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), chains AS (
  SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON c.at = f.word WHERE f.form IS NOT NULL
), roots AS (
  SELECT c.word, c.at AS root FROM chains c JOIN forms f ON c.at = f.word WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
