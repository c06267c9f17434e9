import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from noteloom.llm import html_main, langid, media, packing
from noteloom.llm.base import table

from .conftest import DIR, SCHEMA, document_rows, needs_tables

PATH = public_tokenizers.path("word_bpe_49k.json")


# --- packing


def plain_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(plain_ids, "t"):
        plain_ids.t = Tokenizer.from_file(PATH)
    return [*plain_ids.t.encode(text or "", add_special_tokens=False).ids, 2]


def check_packing(df, got, tiers=packing.TIERS, tasks=1):
    want, have = defaultdict(int), defaultdict(int)
    for r in df.select("doc_id", "text").collect():
        ids = plain_ids(r["text"])
        for i, x in enumerate(ids):
            want[r["doc_id"], i, x] += 1
        plain_ids.kept = getattr(plain_ids, "kept", {}) | {(r["doc_id"], zlib.crc32(np.array(ids, "<u4").tobytes())): ids}
    texts = defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        texts[r["doc_id"]].append(plain_ids(r["text"]))
    sequences = defaultdict(list)
    for p in got:
        fits = [t for t in texts[p["doc_id"]] if len(t) == p["doc_tokens"] and zlib.crc32(np.array(t[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"]]
        assert fits
        for i in range(p["start"], p["start"] + p["length"]):
            have[p["doc_id"], i, fits[0][i]] += 1
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert have == want
    padding = 0
    for pieces in sequences.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at and n > 0
            at += n
        assert at <= max(tiers)
        padding += 0 if at & (at - 1) == 0 else max(tiers) - at
    assert padding <= max(tiers) * tasks


def test_packing_odd(odd, empty):
    one = odd.coalesce(1)
    check_packing(one, packing.pack_documents(one, PATH).collect())
    check_packing(one, packing.pack_documents(one, PATH, buffer_tokens=3000).collect())
    assert packing.pack_documents(empty, PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(odd, PATH, tiers=(500, 1000))


@pytest.mark.parametrize("seed", range(4))
def test_packer_alone(seed):
    r = random.Random(seed)
    p = packing.Packer(0, packing.TIERS, 1 << 16)
    total = 0
    for d in range(400):
        n = int(r.paretovariate(1.1) * r.choice((1, 30, 300))) % 20_000 + 1
        p.document(d, np.full(n, d % 60_000, "<u2"))
        total += n
        if d % 97 == 0:
            p.pack(end=False)
            assert p.tokens < packing.TIERS[0]
    p.pack(end=True)
    assert sum(x[2] for x in p.rows) == total and not p.pieces and not p.waiting
    size = defaultdict(int)
    for x in p.rows:
        size[x[5]] += x[2]
    assert sum(v not in packing.TIERS for v in size.values()) <= 1
    groups = defaultdict(int)
    for x in p.rows:
        groups[x[8]] += x[2]
    assert max(groups.values()) <= 1 << 16


def test_cache_is_bounded_in_bytes():
    import tracemalloc

    rng = random.Random(4)
    letters = [chr(c) for c in range(0x4E00, 0x5200)]
    unspaced = ["".join(rng.choices(letters, k=4000)) for _ in range(60)]
    t = packing.WordCachedTokenizer(PATH, cached_bytes=1 << 20)
    for x in unspaced:
        assert t.ids(x).tolist() == plain_ids(x)[:-1]
    assert not t.known and t.used == 0  # whole texts are not kept
    tracemalloc.start()
    for i in range(300):  # 30,000 different words
        t.ids(" ".join(f"w{i}x{j}" + "y" * (j % 40) for j in range(100)))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert t.used <= (1 << 20) + 200 * 2 * 500 and held < 3 * (1 << 20)


def test_cached_ids_are_the_tokenizer_s():
    t = packing.WordCachedTokenizer(PATH, cached=50)
    for x in ("It's a TEST, don't!  ", "Σας ΟΔΥΣΣΕΥΣ, İstanbul.", "<|endoftext|> x<|endoftext|>y", "a,.b ,%%% 12,3 a1. \x1c\x85  q", "école Å, ﬁ, ǅ. ß.", "日本語、テスト。 x\ty\r\nz", "word, word... Word %%%", "", "\n\n", " ".join(f"w{i}" for i in range(300))):
        assert t.ids(x).tolist() == plain_ids(x)[:-1], x


def test_other_tokenizers_are_read_plainly(tmp_path):
    """A file whose splitter is not the known one, and one with more than 16 bits of ids."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = {w: i for i, w in enumerate(["[UNK]", "a b", "a", "b", *(f"w{i}" for i in range(70_000))])}
    t = Tokenizer(models.WordLevel(words, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Split("|", "removed")
    t.save(str(tmp_path / "t.json"))
    mine = packing.WordCachedTokenizer(str(tmp_path / "t.json"))
    assert not mine.by_words and mine.ids("a b|w69999|x").tolist() == [1, words["w69999"], 0]
    assert packing.WordCachedTokenizer(PATH).by_words


# --- media


def test_media_round_trip(odd, empty):
    rows = {(r["doc_id"], r["text"]) for r in odd.collect()}
    got = media.features(odd).collect()
    assert len(got) == odd.count() and media.features(empty).count() == 0
    want = set()
    for k, t in rows:
        raw = (t or "").encode()
        body = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.add((k, len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:])))
    assert {(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got} == want
    by = {(r["doc_id"], r["n_bytes"]): r for r in got}
    long = next(r for r in got if r["doc_id"] == 5)
    assert by[3, 3]["feature"] == by[4, 3]["feature"] and by[8, 50_000]["feature"] != long["feature"]
    assert len(long["pair_times"]) == len(long["pair_codes"]) == int(long["feature"].split(":")[0])


def test_media_bytes_and_pairs():
    samples = bytes(range(256)) * 3
    stored = media.stored(samples)
    assert media.read_back(stored) == samples and stored[:4] == b"RIFF"
    t = np.arange(19_200)
    tone = (128 + 60 * np.sin(2 * np.pi * 20 * t / 192) + 60 * np.sin(2 * np.pi * 70 * t / 192)).astype(np.uint8).tobytes()
    times, codes = media.peak_pairs(tone)
    assert {(c >> 16, (c >> 4) & 0xFFF, c & 15) for c in codes.tolist()} == {(a, b, d) for a in (20, 70) for b in (20, 70) for d in (1, 2)}
    again = media.peak_pairs(tone, slots=7)
    assert (again[0] == times).all() and (again[1] == codes).all() and (np.diff(times) >= 0).all()


def brute_pairs(samples, frame=192):
    """Peak pairs by a plain Fourier sum."""
    x = [0.0] * (frame // 2) + [b - 32.0 for b in samples] + [0.0] * (frame // 2)
    taper = np.hamming(frame).astype(np.float32)
    wave = np.exp(-2j * np.pi * np.outer(np.arange(frame // 2 + 1), np.arange(frame)) / frame)
    slots = []
    for i in range(0, len(x) - frame + 1, frame // 2):
        power = np.abs(wave @ (np.array(x[i : i + frame], np.float32) * taper)).round(1)
        slot = []
        for band in (range(1, frame // 4), range(frame // 4, frame // 2)):
            tops = [j for j in band if power[j] > power[j - 1] and power[j] >= power[j + 1]] or band
            best = max(tops, key=lambda j: power[j])
            slot += [best] if power[best] > 0 else []
        slots.append(slot)
    return sorted((i, (a << 16) | (b << 4) | d) for i in range(len(slots)) for d in (1, 2) if i + d < len(slots) for a in slots[i] for b in slots[i + d])


def test_media_pairs_against_brute_force():
    r = random.Random(3)
    for text in ("x", "one short text", "another short text", " ".join(f"word{r.randrange(999)}" for _ in range(200))):
        samples = media.payload(text)[1]
        times, codes = media.peak_pairs(samples)
        assert list(zip(times.tolist(), codes.tolist(), strict=True)) == brute_pairs(samples) != []
    short = [media.peak_pairs(media.payload(t)[1])[1].tolist() for t in ("one", "two", "three words here")]
    assert short[0] != short[1] != short[2] != short[0]


# --- language


@needs_tables
def test_languages_held_out(spark):
    d = table(spark, DIR.replace("0.001", "0.01"), "documents")
    model = langid.fit(d)
    assert model.languages == ["de", "en", "es", "fr"]
    got = langid.identify(d, model).join(d.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98 and all(0 <= r["score"] <= 1 for r in got)


def test_filter_returns_all_languages(spark):
    rows = document_rows([(i, " ".join(["alpha beta gamma"] * 5) if i % 2 else " ".join(["delta omega kappa"] * 5)) for i in range(40)])
    df = spark.createDataFrame([(*r[:2], "xx" if r[0] % 2 else "yy", *r[3:]) for r in rows], SCHEMA)
    m = langid.fit(df)
    letters = langid.letter_table()
    assert m.predict("alpha gamma", letters)[0] == "xx" and m.predict("kappa delta", letters)[0] == "yy"
    # no n-gram of the training is lost by the filter
    codes = langid.grams("alpha beta", m.n, letters)
    assert m.counts(codes)[m.languages.index("xx")] > 0.9 * len(codes)


def test_language_odd(odd, empty):
    m = langid.fit(odd)
    got = langid.identify(odd, m).collect()
    assert len(got) == odd.count() and {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 7)} == {"und"}
    assert langid.identify(odd, langid.fit(empty)).where("lang_pred <> 'und' or score <> 0").count() == 0
    assert langid.identify(odd, m, keep_columns=True).columns[: len(odd.columns)] == odd.columns
    clash = odd.withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    assert dict(langid.identify(clash, m, keep_columns=True).dtypes)["score"] == "double"


def test_no_letters_is_und():
    m = langid.Model(["aa"], np.full((1 << 10, 1), 1, np.uint64), np.array([0.5]), 4, 3)
    letters = langid.letter_table()
    assert [m.predict(t, letters)[0] for t in (None, "", "½ ² ①", "12 _ !", "٣", "ª", "x", "Ⅷ")] == ["und"] * 5 + ["aa", "aa", "und"]


def brute_prediction(m, known, text):
    """The language whose exact set of n-grams holds most of the text's."""
    codes = langid.grams(text, m.n, langid.letter_table())
    hits = [sum(c in known[x] for c in codes.tolist()) for x in m.languages]
    return {x for x, h in zip(m.languages, hits, strict=True) if h >= max(hits) - 0.01 * len(codes)}


@needs_tables
def test_filter_against_exact_sets(spark):
    """Predictions from the Bloom filter against plain sets of all n-grams of the learned documents."""
    d = table(spark, DIR, "documents")
    m, letters = langid.fit(d), langid.letter_table()
    rows = d.select("doc_id", "lang", "text").collect()
    known = {x: set() for x in m.languages}
    for r in rows:
        if r["lang"] and r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            known[r["lang"]].update(langid.grams(r["text"], m.n, letters).tolist())
    for r in langid.identify(d, m, keep_columns=True).collect():
        if r["lang_pred"] != "und":
            assert r["lang_pred"] in brute_prediction(m, known, r["text"])


# --- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x="</p>";</script><style>p{}</style></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy now, this is a long advert text</div>
%s
<aside>side</aside><form><label>Mail</label><input></form><footer>foot &copy;</footer></body></html>"""


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><h1>Head &amp; more</h1><p>One <b>two</b><br>three&nbsp;four.<p>Five\n six. <div class=comments><p>A reader says</p></div></article>", "Head & more\n\nOne two three four.\n\nFive six."),
        ("<div id=content><p>First paragraph with enough text to count here.</p><p>Second paragraph with more text than links has it.</p><ul><li>item one<li>item two</ul></div>", "First paragraph with enough text to count here.\n\nSecond paragraph with more text than links has it.\n\nitem one\n\nitem two"),
        ("<main><section><p>a a a a a</p><p>b b b b b</p></section><section><p>c c c</p></section></main>", "a a a a a\n\nb b b b b\n\nc c c"),
        ("<div class='page with-sidebar'><div class=content><p>kept text that is long enough to be most of it all, by far the most of it</p><p>and more of it</p></div><div class=sidebar><p>side note</p></div></div>", "kept text that is long enough to be most of it all, by far the most of it\n\nand more of it"),
        ("<article><p>cut off <i>here", "cut off here"),
    ],
)
def test_pages(body, want):
    assert html_main.main_text(PAGE % body if "cut" not in body else PAGE.split("%s")[0] + body) == want


def test_pages_odd(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "just text &lt;b&gt;"), (3, None, "just text &lt;b&gt;"), (None, "u", "<p>a<!-- x"), (4, "u", "<div>" * 3000 + "deep"), (5, "u", "<p>" + "long " * 50_000), (6, "u", "a < b > c & d"), (7, "u", "<nav>only menu</nav>")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = {r["page_id"]: r for r in html_main.extract(df).collect()}
    assert html_main.extract(df).count() == len(rows) and html_main.extract(df.limit(0)).count() == 0
    assert [got[k]["text"] for k in (1, 2, 3, None, 4, 7)] == ["", "", "just text <b>", "a", "deep", ""]
    assert got[5]["n_chars"] == 5 * 50_000 - 1 and got[6]["text"] == "a < b > c & d"


@needs_tables
def test_page_articles(spark):
    """The table's pages are articles: every paragraph of the article is there and nothing of the rest."""
    import html
    import re

    p = table(spark, DIR, "pages")
    source = {r["page_id"]: r["html"] for r in p.collect()}
    for r in html_main.extract(p).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", source[r["page_id"]], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if x == "br" else "", part)).split()) for part in re.split(r"</?(?:p|h1)>", article) for x in ("br",)]
        assert r["text"].split() == " ".join(w for w in want if w).split()


PARAGRAPHS = [f"Paragraph {i} says enough words, one after another, to look like the text of an article it is." for i in range(5)]
TEXT = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(20)) + "</ul>"
READERS = "<div{}>" + "".join(f"<div><b>Reader {i}</b><span>today</span><p>I agree.</p></div>" for i in range(4)) + "</div>"


@pytest.mark.parametrize(
    "body",
    [
        f"<article>{MENU}{TEXT}</article>", f"<article>{TEXT}{READERS.format('')}</article>", f"<article>{TEXT}{READERS.format(' class=kommentare')}</article>",
        f"{MENU}{TEXT}<p>© 2024 Some Company</p>", f"{MENU}{TEXT}Copyright 2024, all rights reserved.", f"<div>{MENU}</div><div><div>{TEXT}</div></div>",
        f"<div class='wrap'><div>{MENU}</div><div>{TEXT}</div><div>{READERS.format('')}</div></div>", f"<table><tr><td>{MENU}</td><td>{TEXT}</td></tr></table>",
        f"<div class=Kommentare><p>A long reader comment that is as dense as the text of the article itself can ever be.</p></div><article>{TEXT}</article>",
    ],
)
def test_thin_blocks_go_by_density(body):
    """Menus and comments of unknown names go, in an article and without one; every paragraph of the text stays."""
    assert html_main.main_text(f"<html><body>{body}</body></html>").split("\n\n") == PARAGRAPHS


@pytest.mark.parametrize(
    "extra",
    ["<h2>Short head</h2>", "<p>Yes.</p>", "<section><h2>Facts</h2><p>One.</p><p>Two.</p></section>", "<div><p>A note.</p></div>", "<ul><li>one</li><li>two</li></ul>", "<p><a href=x>Source</a></p>", "<p>See <a>a</a>, <a>b</a>, <a>c</a></p>", "<table><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table>"],
)
def test_short_parts_of_an_article_stay(extra):
    import re

    plain = " ".join(re.sub("<[^>]*>", " ", extra).split())
    got = html_main.main_text(f"<html><body><nav>{MENU}</nav><article>{TEXT}{extra}{TEXT}</article></body></html>")
    assert " ".join(got.split()).replace(" ,", ",") == " ".join([*PARAGRAPHS, plain, *PARAGRAPHS]).replace(" ,", ",")


ANSWERS = "<div><div><h3>Q1</h3><p>Short answer one.</p></div><div><h3>Q2</h3><p>Short answer two.</p></div></div>"
CLOSING = "<p>A short closing section of the text.</p>"


@pytest.mark.parametrize(
    "extra",
    [
        ANSWERS, ANSWERS.replace("<div><h3>", "<section><h3>").replace("</p></div>", "</p></section>"),
        "<div class='apple-pie-recipe'><p>Take six apples.</p></div>", "<section id='share-prices'><p>They rose.</p></section>", "<p class='banner-headline'>It rains.</p>",
        "<ul>" + "".join(f"<li><a href='/{i}'>Reference number {i}</a></li>" for i in range(5)) + "</ul>",
    ],
)
def test_an_article_keeps_its_parts(extra):
    import re

    plain = [x for x in (" ".join(x.split()) for x in re.split("<[^>]*>", extra)) if x]
    page = f"<html><body><nav>{MENU}</nav><div class=ad>Buy</div><article>{TEXT}{extra}</article></body></html>"
    assert html_main.main_text(page).split("\n\n") == [*PARAGRAPHS, *plain]


def test_pages_without_article_keep_short_sections():
    page = f"<html><body><div class='site-menu'>{MENU}</div><h1>Title</h1><section>{TEXT}</section><section>{CLOSING}</section><div class='cookie-notice'>We use cookies</div></body></html>"
    assert html_main.main_text(page).split("\n\n") == ["Title", *PARAGRAPHS, "A short closing section of the text."]
    shared = "<div class='share-buttons'><a>Mail this</a> <a>Print this</a></div>"
    assert html_main.main_text(f"<html><body><article>{TEXT}{shared}</article></body></html>").split("\n\n") == PARAGRAPHS


def plain_density(tree, ratio):
    """C, T, LC, LT, density and density sum of (tag, children), by the formula as it is written; sums of those below in a list."""
    import math

    tag, children = tree
    c = t = lc = lt = 0
    total, below = 0.0, []
    for x in children:
        if isinstance(x, str):
            c += len(x.replace(" ", ""))
            continue
        xc, xt, xlc, xlt, density, _, inner = plain_density(x, ratio)
        c, t, lc, lt = c + xc, t + 1 + xt, lc + xlc, lt + xlt + (x[0] == "a")
        total += density
        below += inner
    if tag == "a":
        lc = c
    one = lambda v: max(1, v)
    density = 0.0
    if c:
        base = math.log(math.log(c / one(c - lc) * one(lc) + ratio * c + math.e) + 1e-9) if lc else math.log(math.log(c / one(c) * 0 + ratio * c + math.e) + 1e-9)
        density = c / one(t) * math.log(max(1.0, c / one(lc) * one(t) / one(lt))) / max(base, 1e-2)
    return c, t, lc, lt, density, total, [*below, (tag, density, total)]


def test_densities_are_those_of_the_formula():
    rng = random.Random(8)

    def tree(depth):
        tag = rng.choice(["div", "section", "p", "a", "b"]) if depth else "body"
        inline = tag in ("p", "a", "b")
        children = [rng.choice(["some text", "x", "a longer run of words here"]) if rng.random() < 0.5 or depth > 4 else ("b", ["w"]) if inline else tree(depth + 1) for _ in range(rng.randrange(0, 5))]
        return tag, children

    markup = lambda t: t if isinstance(t, str) else f"<{t[0]}>{''.join(map(markup, t[1]))}</{t[0]}>"
    for _ in range(60):
        t = tree(0)
        root = html_main.parse(f"<html>{markup(t)}</html>")
        body = html_main.measured(root)
        ratio = plain_density(t, 0)
        want = plain_density(t, ratio[2] / max(1, ratio[0]))[6]
        got, stack = [], [body]
        while stack:
            node = stack.pop()
            got.append((node.tag, node.density, node.total))
            stack += [x for x in node.children if not isinstance(x, str)]
        assert [x[0] for x in sorted(got)] == [x[0] for x in sorted(want)]
        for (_, d, s), (_, d2, s2) in zip(sorted(got), sorted(want), strict=True):
            assert (d, s) == (pytest.approx(d2), pytest.approx(s2))


@pytest.mark.parametrize(
    ("page", "want"),
    [("<p title=don't>hello world</p>", "hello world"), ("<p title='a > b'>x</p>", "x"), ('<p title="it\'s">x</p><p>y</p>', "x\n\ny"), ("<p a=\"open>x</p><p>y</p>", "x\n\ny"), ("if a <b then c", "if a <b then c"), ("<p>a</p><p cla", "a\n\n<p cla"), ("<a href=x'y'z>t</a>", "t"), ("<p a = 'v>w' >x", "x")],
)
def test_quotes_and_cut_tags(page, want):
    assert html_main.main_text(page) == want


@pytest.mark.parametrize("piece", ["<a x='", '<a x="', "<a x='>", "<p ", "<ul>", "<li>", "<b><p>", "<table><i>", "</p>", "<!--", "<a =", "&amp", "<script>", "<div><p>x<br></p>", "<td><li>"])
def test_hostile_pages_are_linear(piece):
    import time

    page = "<p>text</p>" + piece * (1_000_000 // len(piece))
    began = time.process_time()
    html_main.main_text(page)
    assert time.process_time() - began < 20  # seconds on a busy machine


@pytest.mark.parametrize("sizes", [(5, 4), (8, 6, 6), (20, 15, 10)])
def test_sections_beside_the_densest(sizes):
    """All sections of a page without article count, and bare text beside them; a bar of links does not."""
    paragraphs = [[f"s{i}p{j} " + "plain words of a paragraph " * 6 for j in range(n)] for i, n in enumerate(sizes)]
    sections = "".join("<div><div>" + "".join(f"<p>{p}</p>" for p in ps) + "</div></div>" for ps in paragraphs)
    links = "".join(f"<a href='/{i}'>link {i}</a> | " for i in range(9))
    page = f"<html><body><div>{links}</div>Bare <b>lead</b> text.<div>{sections}</div>{links}</body></html>"
    assert html_main.main_text(page).split("\n\n") == ["Bare lead text.", *(p.strip() for ps in paragraphs for p in ps)]
