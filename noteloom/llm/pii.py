"""Personal data: fixed patterns, and high-recall candidates that boosted trees accept or refuse.

Generators propose spans that may overlap others: mail-like strings (also with "(at)", "(dot)" or spaces) and
number-like strings (digits with separators, parentheses, a plus): whole runs, what spans of the fixed patterns leave
of a run, and the card- and phone-shaped pieces that start anywhere in it, so that numbers side by side are candidates
of their own. Features describe a candidate's format (length, digits, groups, separators, Luhn sum, octets) and its
context (words before it, neighbouring characters and numbers). A forest of small trees, fitted by gradient boosting of
the logistic loss, scores them; Platt scaling turns scores into probabilities and a threshold for each generator is set
where held-out precision reaches `precision`. Accepted spans that overlap no span of the fixed patterns are added as
kinds "mail" and "number"; of number candidates that overlap, the most probable one stays.

The trees are fitted here, on `examples` labelled candidates written by a seeded generator of formats and contexts (the
bound of the sample); no row of the corpus is used, so every size of corpus meets the same model. Features of the
examples and of the corpus come from the same column expressions, and scoring is one column expression too.

Spans are in code points, end exclusive. Null text counts as empty: no spans. Repeated rows stay; empty tables give none.
"""

from __future__ import annotations

import random
import re
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import let, matches, prefixes, unused
from .secrets_scan import SPANS, as_text, masked

KINDS = ("email", "ip", "card", "phone", "mail", "number")
# Runs are possessive and start at the run's first character (or where the last match ended), which gives the same
# matches as the plain patterns and keeps long runs linear. Repeated groups are possessive too: a greedy one takes a
# frame of the JVM's stack for every repeat, so a long dotted run would end the executor.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
MAIL_LIKE = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)*+"
NUMBER_LIKE = r"\+?\(?[0-9][0-9().\x20/:-]*[0-9]"
# Pieces of runs, one at every start: the character consumed is the first, the piece is group 1, so pieces may overlap.
_SHAPED = r"(?<![0-9(+])(?=(%s)(?![0-9]))[0-9(+]"
SHAPES = (
    _SHAPED % r"[0-9]{12,19}|[0-9]{4}([\x20-])[0-9]{4}\2[0-9]{4}\2[0-9]{1,7}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}",
    _SHAPED % r"(?:\+?[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|0[0-9]{2,4}[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,4}",
    _SHAPED % r"\+?[0-9]{1,4}\x20[0-9]{2,4}\x20[0-9]{3,4}\x20[0-9]{3,4}",
)
#: Numbers whose form says enough: the shapes but for their look-arounds.
SHAPED = r"\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}|0[0-9]{3}\x20[0-9]{3}\x20[0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}"
FEATURES = ("chars", "digits", "letters", "dots", "dashes", "spaces", "slashes", "colons", "brackets", "plus", "at", "dotword", "groups", "longest", "shortest", "luhn", "octets", "hint", "against", "glued", "beside", "first", "second", "third", "last", "year")
HINTS = r"(?i)(?<![a-z])(phone|tel|call|mobile|fax|mail|contact|card|visa|account|iban|ssn|social security|reach|write)[^.!?]{0,16}$"
AGAINST = r"(?i)(?<![a-z])(version|v\.|order|invoice|date|page|isbn|no\.|nr|#|on|since|in|from|at|between|total|price|sum|born|ticket|build)[^.!?A-Za-z]{0,6}$"
_none = lambda: F.array().cast(SPANS)


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(acc: Column, x: Column) -> Column:
        d = x.cast("int")
        twice = F.when(acc["odd"], d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))
        return F.struct((acc["sum"] + twice).alias("sum"), (~acc["odd"]).alias("odd"))

    return F.aggregate(F.filter(F.split(F.reverse(digits), ""), lambda x: x != ""), F.struct(F.lit(0).alias("sum"), F.lit(True).alias("odd")), add, lambda acc: acc["sum"] % 10 == 0)


def octets(s: Column) -> Column:
    return s.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, sorted by start, then kind."""

    def found(kind: int, pattern: str, guard: Column, good) -> Column:
        spans = F.transform(F.filter(matches(text, pattern), good), lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
        return F.when(guard, spans).otherwise(_none())

    count = lambda x: F.length(digits_of(x["hit"]))
    any_digit = text.rlike("[0-9]")
    return F.sort_array(
        F.concat(
            found(0, EMAIL, text.contains("@"), lambda x: F.lit(True)),
            found(1, IP, any_digit & text.contains("."), lambda x: octets(x["hit"])),
            found(2, CARD, any_digit, lambda x: F.when(count(x).between(12, 19), luhn(digits_of(x["hit"]))).otherwise(False)),
            found(3, PHONE, text.contains("+"), lambda x: count(x).between(9, 15)),
        )
    )


def features(hit: Column, before: Column, after: Column) -> Column:
    """struct of doubles, named as in FEATURES, of a candidate, the characters before it and the few after it."""
    left = lambda p: F.length(hit) - F.length(F.regexp_replace(hit, p, ""))
    groups = F.filter(F.split(hit, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, lambda g: F.length(g))
    flag = lambda c: c.cast("int")
    digits = digits_of(hit)
    values = (
        F.length(hit), F.length(digits), left("[A-Za-z]"), left(r"\."), left("-"), left(r"\x20"), left("/"), left(":"), left(r"[()\[\]]"), flag(hit.startswith("+")),
        flag(hit.contains("@")), flag(hit.rlike(r"\.[A-Za-z]|dot")), F.size(groups), F.coalesce(F.array_max(sizes), F.lit(0)), F.coalesce(F.array_min(sizes), F.lit(0)),
        flag(F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)), flag(octets(hit)), flag(before.rlike(HINTS)), flag(before.rlike(AGAINST)),
        flag(before.rlike(r"[A-Za-z0-9_]$")) + flag(after.rlike(r"^[A-Za-z0-9_%]")),
        flag(before.rlike(r"[0-9][().\x20/:-]{1,3}$")) + flag(after.rlike(r"^[().\x20/:-]{1,3}[0-9]")),
        *[F.coalesce(F.get(sizes, i), F.lit(0)) for i in range(3)], F.coalesce(F.get(sizes, F.size(sizes) - 1), F.lit(0)), flag(hit.rlike(r"(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)")),
    )
    return F.struct(*[v.cast("double").alias(n) for v, n in zip(values, FEATURES, strict=True)])


# --- fitting -------------------------------------------------------------------------------------------------------


def examples(n: int, seed: int) -> list[tuple[str, str, str, int, int]]:
    """(before, candidate, after, generator, label): formats and contexts of personal data and of what resembles it."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))

    def card(valid: bool) -> str:
        s = r.choice("3456") + d(14)
        total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(s))
        check = -total % 10 if valid else (-total + r.randint(1, 9)) % 10
        s += str(check)
        sep = r.choice(["", " ", "-"])
        return sep.join(s[i : i + 4] for i in range(0, 16, 4))

    def national() -> str:
        """A number as some country writes it: a trunk prefix or none, and groups of any size between any signs."""
        rest = d(r.randint(7, 10))
        sizes, sep = [], r.choice(["", " ", " ", "-", ".", "/"])
        while sum(sizes) < len(rest):
            sizes.append(min(r.randint(2, 8), len(rest) - sum(sizes)))
        groups = [rest[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes))]
        first = r.choice([f"0{d(r.randint(1, 4))}", f"0{d(r.randint(1, 4))}", f"(0{d(r.randint(1, 4))})", f"00{d(2)}", d(r.randint(2, 4))])
        return first + r.choice([sep, "/", " "]) + sep.join(groups)

    host = lambda: word() + r.choice([" (dot) ", "[dot]", ".", " . "]) + r.choice(["com", "org", "net", "de"])
    good = ["call me at ", "my phone: ", "tel. ", "contact ", "card number ", "Mobile ", "write to ", "account "]
    bad = ["version ", "order ", "invoice no. ", "page ", "in ", "on ", "from ", "since ", "total ", "build ", "ticket #"]
    yes = [
        lambda: (f"({d(3)}) {d(3)}-{d(4)}", 1, 0.6), lambda: (f"{d(3)}-{d(3)}-{d(4)}", 1, 0.9), lambda: (f"+{r.randint(1, 99)} {d(2)} {d(4)} {d(4)}", 1, 0.4), lambda: (f"{d(3)}.{d(3)}.{d(4)}", 1, 0.6),
        lambda: (f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", 1, 0.4), lambda: (f"0{d(3)} {d(3)} {d(4)}", 1, 0.4), lambda: (card(True), 1, 0.5), lambda: (f"{d(3)}-{d(2)}-{d(4)}", 1, 1.0), lambda: (national(), 1, 1.0), lambda: (national(), 1, 1.0), lambda: (f"{word()} (at) {host()}", 0, 0.4), lambda: (f"{word()}[at]{host()}", 0, 0.4), lambda: (f"{word()}.{word()}@{word()}.com", 0, 0.4),
    ]
    # A number's form alone is no proof: the national ones are personal beside a hint and nothing without one.
    no = [
        lambda: (f"20{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)} {r.randint(10, 23)}:{r.randint(10, 59)}", 1), lambda: (f"{r.randint(10, 28)}/{r.randint(10, 12)}/19{d(2)}", 1), lambda: (f"{r.randint(1, 9)}.{d(2)}.{d(3)}.{d(4)}", 1), lambda: (f"{r.randint(1, 999)}.{d(3)}.{d(3)}", 1),
        lambda: (r.choice("-/.").join(r.choice([[f"{r.choice((19, 20))}{d(2)}", f"{r.randint(1, 12):02}", f"{r.randint(1, 31):02}"], [f"{r.randint(1, 31):02}", f"{r.randint(1, 12):02}", f"{r.choice((19, 20))}{d(2)}"]])), 1),
        lambda: (f"19{d(2)}-20{d(2)}", 1), lambda: (d(r.randint(7, 11)), 1), lambda: (d(r.randint(12, 24)), 1), lambda: (card(False), 1), lambda: (" ".join(d(r.randint(1, 5)) for _ in range(r.randint(3, 8))), 1), lambda: (f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", 1),
        lambda: (next(x for x in iter(national, "") if not re.fullmatch(SHAPED, x)), 1), lambda: (next(x for x in iter(national, "") if not re.fullmatch(SHAPED, x)), 1), lambda: (f"{d(2)}.{d(5)} {d(2)}.{d(5)}", 1), lambda: (f"{word()} @{word()}", 0), lambda: (f"{word()} @ {d(2)}", 0), lambda: (f"{word()}@{word()}", 0), lambda: (f"{word()} @ {word()}", 0),
    ]
    out = []
    for i in range(n):
        if i % 2:
            text, kind, hinted = r.choice(yes)()
            before = r.choice(good) if r.random() < hinted else f"{word()} {word()} "
            after = r.choice([" ", ".", ",", ""])
            if kind and r.random() < 0.2:  # another number of a person stands beside it
                other = r.choice([card(True), f"({d(3)}) {d(3)}-{d(4)}", f"10.{d(2)}.{d(2)}.{d(3)}"])
                before, after = r.choice([(f"{before}{other} ", after), (before, f" {other}")])
            out.append((before[-24:], text, after[:4], kind, 1))
        else:
            text, kind = r.choice(no)()
            before = r.choice(bad) if r.random() < 0.5 else f"{word()} {word()} " if r.random() < 0.9 else word()
            after = r.choice([" ", ".", ",", "", "x", "%"])
            if kind and r.random() < 0.2:  # a piece of a longer list of digits
                text = r.choice([text, card(False), f"{d(3)} {d(3)} {d(4)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}"])
                before, after = r.choice([(f"{before}{d(r.randint(1, 6))}{r.choice(' -.')}", after), (before, f"{r.choice(' -.')}{d(4)}")])
            elif kind and r.random() < 0.1:  # a hint, but the sum of no card
                before, text = r.choice(good), card(False)
            out.append((before[-24:], text, after[:4], kind, 0))
    return out


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> tuple | float:
    """A regression tree on gradients: (feature, threshold, if at most, if more), or a leaf."""
    leaf = -rate * float(g.sum()) / float(h.sum() + 1)
    if depth == 0 or len(x) < 20:
        return leaf
    best, whole = (1e-6, 0, 0.0), g.sum() ** 2 / (h.sum() + 1)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for t in np.unique(np.quantile(values, np.linspace(0, 1, 17)[:-1], method="lower")):
            low = x[:, j] <= t
            if 5 <= low.sum() <= len(x) - 5:
                gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (low, ~low)) - whole
                best = max(best, (float(gain), j, float(t)))
    gain, j, t = best
    if gain <= 1e-6:
        return leaf
    low = x[:, j] <= t
    return j, t, grow(x[low], g[low], h[low], depth - 1, rate), grow(x[~low], g[~low], h[~low], depth - 1, rate)


def value(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], value(tree[2], x), value(tree[3], x))


_models: dict[tuple, tuple] = {}


def fit(spark: SparkSession, n: int = 6000, seed: int = 7, trees: int = 30, depth: int = 4, rate: float = 0.3, precision: float = 0.97) -> tuple[list, tuple[float, float], list[float]]:
    """Trees, the two numbers of Platt scaling, and the probability that each generator's candidates must reach."""
    key = (n, seed, trees, depth, rate, precision)
    if key in _models:
        return _models[key]
    rows = examples(n, seed)
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, before string, hit string, after string, kind int, label int")
    got = sorted(df.select("i", features(F.col("hit"), F.col("before"), F.col("after")).alias("f")).collect())
    x, y, kind = np.array([list(r.f) for r in got]), np.array([r[4] for r in rows]), np.array([r[3] for r in rows])
    fold = np.arange(n) % 6 >= 4  # held out, both labels alike
    margin, forest = np.zeros(n), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        forest.append(grow(x[~fold], (p - y)[~fold], (p * (1 - p))[~fold], depth, rate))
        margin += value(forest[-1], x)
    a, b = 1.0, 0.0
    for _ in range(500):  # Platt scaling on the held-out part
        p = 1 / (1 + np.exp(-(a * margin[fold] + b)))
        a, b = a - 0.1 * float(((p - y[fold]) * margin[fold]).mean()), b - 0.1 * float((p - y[fold]).mean())
    prob = 1 / (1 + np.exp(-(a * margin + b)))
    least = []
    for k in (0, 1):
        m = fold & (kind == k)
        cuts = [t for t in np.unique(prob[m]) if y[m & (prob >= t)].mean() >= precision]
        least.append(max(0.5, float(min(cuts, default=2.0))))
    _models[key] = forest, (a, b), least
    return _models[key]


def score(f: Column, model: tuple) -> Column:
    """The probability of a struct of features."""
    forest, (a, b), _ = model

    def one(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(f[FEATURES[tree[0]]] <= tree[1], one(tree[2])).otherwise(one(tree[3]))

    return 1 / (1 + F.exp(-(reduce(lambda p, q: p + q, map(one, forest)) * a + b)))


# --- spans ---------------------------------------------------------------------------------------------------------


#: Code points of a cell: what a candidate meets, and what stands around it, is looked up in its cells and not in the whole text.
CELL = 512


def _over(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def _later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _cells(x: Column) -> Column:
    """Numbers of the cells that a span touches."""
    return F.sequence(F.floor(x["start"] / CELL), F.floor(F.greatest(x["start"], x["end"] - 1) / CELL))


def spans_by_cell(spans: Column, length: Column) -> Column:
    """For each cell of a text of that length the spans that touch it, sorted by start; spans must be sorted so."""

    def dealt(entries: Column) -> Column:
        numbers = F.transform(entries, lambda e: e["cell"])

        def cell(k: Column, ups: Column, downs: Column) -> Column:
            first, last = F.array_position(ups, k), F.size(ups) + 1 - F.array_position(downs, k)
            return F.when(first == 0, F.filter(spans, lambda _: F.lit(False))).otherwise(F.transform(F.slice(entries, F.greatest(first, F.lit(1)).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")), lambda e: e["span"]))

        return let(numbers, lambda ups: let(F.reverse(ups), lambda downs: F.transform(F.sequence(F.lit(0).cast("long"), F.floor(length / CELL)), lambda k: cell(k, ups, downs))))

    entries = F.flatten(F.transform(spans, lambda x: F.transform(_cells(x), lambda k: F.struct(k.alias("cell"), x.alias("span")))))
    return let(F.sort_array(entries), dealt)


def _pieces(text: Column) -> Column:
    """The text of each cell with 24 code points before it and 8 behind it; one more than there are, for the text's end."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CELL}}}"), F.lit(0))
    before = lambda ps, i: F.coalesce(F.right(F.get(ps, i - 1), F.lit(24)), F.lit(""))
    after = lambda ps, i: F.coalesce(F.left(F.get(ps, i + 1), F.lit(8)), F.lit(""))
    return let(parts, lambda ps: F.transform(F.concat(ps, F.array(F.lit(""))), lambda p, i: F.concat(before(ps, i), p, after(ps, i))))


def candidates(text: Column, cells: Column) -> tuple[Column, Column]:
    """Spans (start, end, hit) of mail-like and of number-like candidates, which overlap no span of the cells but perhaps each other."""
    span = lambda start, hit: F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("hit"))
    here = lambda k: F.get(cells, k.cast("int"))
    free = lambda x: ~F.exists(_cells(x), lambda k: F.exists(here(k), lambda b: _over(b, x)))

    def rest(x: Column) -> Column:
        """The parts of a run that base spans leave, each from its first digit, bracket or plus to its last digit."""
        met = F.array_distinct(F.filter(F.flatten(F.transform(_cells(x), here)), lambda b: _over(b, x)))
        after = lambda m: F.zip_with(prefixes(F.transform(m, lambda b: b["end"]), F.lit(0), _later), m, lambda before, b: F.greatest(before, b["end"]))

        def part(a: Column, to: Column) -> Column:
            piece = F.substring(x["hit"], (a - x["start"] + 1).cast("int"), F.greatest(to - a, F.lit(0)).cast("int"))
            return span(a + F.greatest(F.regexp_instr(piece, F.lit(NUMBER_LIKE)) - 1, F.lit(0)), F.regexp_extract(piece, NUMBER_LIKE, 0))

        return let(met, lambda m: F.zip_with(F.concat(F.array(x["start"]), after(m)), F.concat(F.transform(m, lambda b: b["start"]), F.array(x["end"])), part))

    runs = F.flatten(F.transform(matches(text, NUMBER_LIKE), lambda x: F.when(free(x), F.array(span(x["start"], x["hit"]))).otherwise(rest(x))))
    shaped = [F.filter(F.transform(matches(text, p, 1), lambda x: span(x["start"], x["part"])), free) for p in SHAPES]
    numbers = F.array_distinct(F.filter(F.concat(runs, *shaped), lambda x: F.length(digits_of(x["hit"])) >= 7))
    return F.transform(F.filter(matches(text, MAIL_LIKE), free), lambda x: span(x["start"], x["hit"])), numbers


def accepted(kind: int, found: Column, pieces: Column, model: tuple) -> Column:
    """p (negative), size (negative), start, end of the candidates that reach their threshold."""

    def part(first: Column, size: Column, k: Column) -> Column:
        return F.substring(F.get(pieces, k), (first - F.greatest(k * CELL - 24, F.lit(0)) + 1).cast("int"), size.cast("int"))

    def described(x: Column) -> Column:
        cell = lambda at: F.floor(at / CELL).cast("int")
        low = F.greatest(x["start"] - 24, F.lit(0))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), features(x["hit"], part(low, x["start"] - low, cell(x["start"])), part(x["end"], F.lit(4), cell(x["end"]))).alias("f"))

    rated = F.transform(F.transform(found, described), lambda x: F.struct((-score(x["f"], model)).alias("p"), (x["start"] - x["end"]).alias("size"), x["start"].alias("start"), x["end"].alias("end")))
    return F.filter(rated, lambda x: -x["p"] >= model[2][kind - 4])


def by_place(found: Column) -> Column:
    order = lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(F.signum(b["end"] - a["end"]).cast("int"))
    return F.when(F.size(found) < 2, found).otherwise(F.array_sort(found, order))


def apart(placed: Column, reach: Column) -> Column:
    """Of overlapping spans the first by probability and length. placed: by_place(); reach: where the spans before each end.

    A span that starts behind all before it begins a cluster, and only spans of one cluster are compared.
    """

    def best(cluster: Column) -> Column:
        add = lambda kept, x: F.when(F.exists(kept, lambda y: _over(x, y)), kept).otherwise(F.concat(kept, F.array(x)))
        return F.when(F.size(cluster) < 2, cluster).otherwise(F.aggregate(F.sort_array(cluster), F.slice(cluster, 1, 0), add))

    heads = F.filter(F.transform(placed, lambda x, i: F.when(x["start"] >= F.get(reach, i), i + 1)), lambda i: i.isNotNull())
    ends = lambda h: F.concat(F.slice(h, F.lit(2), F.size(h)), F.array(F.size(placed) + 1))
    return F.when(F.size(placed) < 2, placed).otherwise(let(heads, lambda h: F.flatten(F.zip_with(h, ends(h), lambda i, j: best(F.slice(placed, i, j - i))))))


def with_spans(docs: DataFrame, model: tuple) -> DataFrame:
    """docs with base and spans: arrays of (start, kind, end), sorted by start, then kind (an index of KINDS).

    Scored spans are accepted candidates that overlap no base span; of numbers that overlap, the most probable stays, then
    the longest. Candidates are compared with the base spans of their cells, and with each other in clusters, so the work
    grows with the text and not with its square. Every step is a column of its own, which keeps the expressions shallow.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    cells, pieces, mails, numbers, reach = (unused(docs, x) for x in ("cells", "pieces", "mails", "numbers", "reach"))
    mail = text.contains("@") | text.contains("(at)") | text.contains("[at]")
    number = text.rlike(r"[0-9][^\n]{5,}[0-9]")
    as_kind = lambda kind, found: F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    some = lambda guard, column: F.when(guard, column)  # noqa: E731  null where there is nothing to look at
    df = docs.withColumn("base", base_spans(text))
    df = df.withColumns({cells: some(mail | number, spans_by_cell(F.col("base"), F.length(text))), pieces: some(mail | number, _pieces(text))})
    found = candidates(text, F.col(cells))
    df = df.withColumns({mails: some(mail, found[0]), numbers: some(number, found[1])})
    df = df.withColumns({mails: accepted(4, F.col(mails), F.col(pieces), model), numbers: by_place(accepted(5, F.col(numbers), F.col(pieces), model))})
    df = df.withColumn(reach, prefixes(F.transform(numbers, lambda x: x["end"]), F.lit(0), _later))
    more = [F.coalesce(as_kind(4, F.col(mails)), _none()), F.coalesce(as_kind(5, apart(F.col(numbers), F.col(reach))), _none())]
    return df.withColumn("spans", F.sort_array(F.concat("base", *more))).drop(cells, pieces, mails, numbers, reach)


def scan(docs: DataFrame, model: tuple | None = None) -> DataFrame:
    """doc_id, counts by kind, the digest of the fixed patterns' spans, and all spans, for every row of docs (doc_id, text)."""
    f = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model or fit(docs.sparkSession))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return f.select("doc_id", *[n(k) for k in range(4)], F.sha2(as_text(F.col("base"), KINDS), 256).alias("base_sha256"), as_text(F.col("spans"), KINDS).alias("spans"), n(4), n(5))


def redact(docs: DataFrame, mark: str = "[REDACTED]", model: tuple | None = None) -> DataFrame:
    """docs with its columns, every span replaced by mark."""
    names = docs.columns
    s = with_spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text")), model or fit(docs.sparkSession))
    text = masked(F.col("text"), F.col("spans"), mark)
    return s.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])
