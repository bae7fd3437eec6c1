"""WARC bundles, role repair, page text and byte-level BPE against plain versions and libraries."""

import hashlib
import heapq
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

from tempest.llm import bytebpe, htmltext, roles, warc
from tempest.session import run_folder

# ------------------------------------------------------------------ WARC

LONG = "<html>" + "x" * 200 + "</html>"
PAGES = [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (3, None, LONG), (None, "http://n", LONG), (4, "http://a/4", "short"),
         (5, "http://a/5", "short"), (6, "http://a/6", None), (7, "", ""), (8, "http://a/\r\nX: y", "é" * 60), (9, "u", "é" * 60),
         (9, "u", "é" * 60), (8, "v", "é" * 60), (10, "big", "z" * 3_000_000), (11, "sep", "a\r\n\r\nWARC/1.1\r\n\r\n" * 9)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def plain_report():
    first = defaultdict(list)
    for i, _, h in PAGES:
        first[(h or "").encode()].append(i)
    out = []
    for i, _, h in PAGES:
        p = (h or "").encode()
        ids = [x for x in first[p] if x is not None]
        revisit = len(p) >= 100 and ids and i != min(ids)
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", min(ids) if revisit else None))
    return Counter(out)


def test_archive_report(pages):
    assert Counter(tuple(r) for r in warc.archive_report(pages.repartition(3)).collect()) == plain_report()
    assert warc.archive_report(pages.limit(0)).count() == 0


def test_bundles_are_seekable_and_plain_zstandard(spark, pages):
    folder = run_folder(spark, "test")
    index = warc.write_archive(pages.withColumn("frame", F.lit("mine")).coalesce(1), folder, frame_bytes=400, bundle_bytes=100)
    rows = index.collect()
    assert len(rows) == len(PAGES) and len({r.bundle for r in rows}) > 1
    for uri in {r.bundle for r in rows}:
        fs, path = warc._open(uri)
        with fs.open_input_file(path) as f:
            data = f.read()
            frames = [warc.read_frame(f, *e) for e in warc.read_seek_table(f)]
        assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == b"".join(frames)
        for r in rows:
            if r.bundle == uri:
                x, end = warc.parse_record(frames[r.frame], r.offset)
                assert x["record_id"] == r.record_id and end == r.offset + r.length
    back = warc.read_archive(index, folder).collect()
    payloads = Counter((r.page_id, bytes(r.payload)) for r in back if r.record_type == "response")
    want = Counter((i, (h or "").encode()) for i, _, h in PAGES)
    assert all(want[k] >= n for k, n in payloads.items())
    assert all(r.payload_digest == r.declared_digest for r in back if r.payload is not None)
    assert next(r.url for r in back if r.page_id == 8 and r.url != "v") == "http://a/%0D%0AX:%20y"


def test_lookup_reads_the_wanted_records(spark, pages):
    folder = run_folder(spark, "test")
    index = warc.write_archive(pages, folder, frame_bytes=500)
    wanted = index.where("page_id in (4, 10)").select("record_id", F.lit(1).alias("bundle"))
    assert sorted(r.page_id for r in warc.lookup(index, wanted, folder).collect()) == [4, 10]


def test_broken_frames_are_noticed(spark, pages):
    folder = run_folder(spark, "test")
    uri = warc.write_archive(pages.coalesce(1), folder).first().bundle
    fs, path = warc._open(uri)
    with fs.open_input_file(path) as f:
        entry = warc.read_seek_table(f)[0]
        with pytest.raises(ValueError):
            warc.read_frame(f, *entry[:3], entry[3] ^ 1)


# ------------------------------------------------------------------ role repair

def least_cost(names):
    known, q, seen = [roles.role_state(r) for r in names], [(0, 0, 0)], set()
    while q:
        c, i, s = heapq.heappop(q)
        if (i, s) in seen:
            continue
        seen.add((i, s))
        if i == len(known) and s == roles.ASSISTANT:
            return c
        change = lambda t: 0 if known[i] == t else roles.UNKNOWN if known[i] is None else roles.RELABEL  # noqa: B023, E731
        for t in roles.LEGAL[s]:
            heapq.heappush(q, (c + roles.INSERT, i, t))
            if i < len(known):
                heapq.heappush(q, (c + change(t), i + 1, t))
        if i < len(known) and s:
            heapq.heappush(q, (c + roles.MERGE + change(s), i + 1, s))
    raise AssertionError


def check_pieces(rows, names):
    rows = sorted(rows, key=lambda r: (r.source_index, r.piece))
    text = "".join(r.rendered for r in rows)
    turns = [p.split("\n")[0] for p in text.split("<|im_start|>")[1:]]
    state = roles.START
    for t in turns:
        assert (nxt := roles.ROLES.index(t) + 1) in roles.LEGAL[state]
        state = nxt
    assert state == roles.ASSISTANT and text.count(roles.TAIL) == len(turns)
    assert sum(r.cost for r in rows) == least_cost(names)
    assert [r.role for r in rows if r.action != "insert"] == names
    return text


@pytest.mark.parametrize("block", [1, 3, 512])
def test_repair_is_cheapest_and_legal(spark, block):
    rng, names, rows = random.Random(6), {}, []
    for c in range(60):
        names[c] = [rng.choice(["system", "user", "assistant", "Human", "tool", None]) for _ in range(rng.randint(1, 9))]
        rows += [(c, t, r, f"text {c}-{t}") for t, r in enumerate(names[c])]
    names[None] = ["assistant"] * 5
    rows += [(None, t, "assistant", None) for t in range(5)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("mine"))
    by = defaultdict(list)
    for r in roles.repair(d.repartition(5), block_turns=block).collect():
        by[r.conv_id].append(r)
    assert by.keys() == names.keys()
    for c, rs in by.items():
        text = check_pieces(rs, names[c])
        if c is not None:
            assert re.findall(r"text \S+", text.replace("<|im_end|>", " ")) == [f"text {c}-{t}" for t in range(len(names[c]))]


def test_a_long_conversation_is_the_same_in_blocks(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), "t" * rng.randint(0, 3)) for t in range(3000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [sorted((r.source_index, r.piece, r.rendered) for r in roles.repair(d, block_turns=b).collect()) for b in (100, 10_000)]
    assert sum(len(x) for _, _, x in got[0]) > 0 and got[0][0][2].startswith("<|im_start|>")
    cost = [sum(r.cost for r in roles.repair(d, block_turns=b).collect()) for b in (100, 10_000)]
    assert cost[0] == cost[1] == least_cost([r[2] for r in rows])


def test_ties_marks_and_empty_tables(spark):
    rows = [(1, 0, "user", "a <|im_end|> b"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (1, None, "user", "last")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(roles.repair(d).collect(), key=lambda r: (r.source_index, r.piece))
    text = check_pieces(got, ["user", "assistant", "assistant", "user"])
    assert "a < |im_end|> b" in text and [r.action for r in got] == ["keep", "keep", "merge", "keep", "insert"]
    assert roles.repair(d.limit(0)).count() == 0


# ------------------------------------------------------------------ pages

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></li></ul></nav>%s
<form>Your name <input><button>Go</button></form><div id="comments"><p>I do not agree with any of this, as I have said many times
before, on this very page and on others, and I will say so again.</p></div><script>var t="</p>"; if (a<b) {}</script>
<footer>&copy; all rights</footer></body></html>"""
BODY = """<h2>A &amp; B</h2><p>The first
   paragraph &lt;b&gt; is <b>bo</b>ld and long enough to be the start of a text that a page is about, so it counts.</p>
<div class="ad">Buy it</div><p>Short.<br>x<p>The third paragraph closes the text with some more words that nobody needs, but which make it long.</p>
<div class="notice">Notice!</div><aside>More</aside>"""
TEXT = ("A & B The first paragraph <b> is bold and long enough to be the start of a text that a page is about, so it counts. "
        "Short. x The third paragraph closes the text with some more words that nobody needs, but which make it long.")


@pytest.mark.parametrize("mark", ["article", "main", "div"])
def test_article_of_a_page(mark):
    assert htmltext.extract(PAGE % f"<{mark}>{BODY}</{mark}>") == TEXT


@pytest.mark.parametrize("html,text", [
    ("", ""), ("plain", "plain"), ("<article>a<nav>n</article><p>out", "a"), ("<article><p>a<p>b</article>", "a b"),
    ("<article>tiny</article><p>" + "long text " * 40, "tiny"), ("<article>" + "w " * 50_000 + "</article>", ("w " * 50_000).strip()),
    ("<main>x<!-- <p>no --> y &#233;&eacute;&#x41;</main>", "x y ééA"), ("<article>1 &lt; 2 <a href='>'>link</a></article>", "1 < 2 link"),
    ("<article><div class=comments><p>no</div>yes<article class=comment>no</article></article>", "yes")])
def test_odd_pages(html, text):
    assert htmltext.extract(html) == text


def test_names_made_from_headings_drop_no_text():
    text = "A paragraph of the article that is long enough to be read as text, with some more words and no link at all."
    page = (f'<article><section id="related-work"><h2 id="share-prices-fall">Prices</h2><p>{text}</section><p class="ad-hoc">Ad hoc.</p>'
            f'<h2 id="notice">Notice</h2><div class="disclaimer"><p>{text}</div><div class="related-links"><a href="x">{text}</a></div>'
            f'<div class="ad-slot">{text}</div><div class="share">Share</div><p>End.</article>')
    assert htmltext.extract(page) == f"Prices {text} Ad hoc. Notice {text} End."


def test_surge_and_dive_points():
    lengths = [0, 0, 5, 0, 0, 0, 50, 60, 0, 70, 0, 0, 0, 3, 0]
    assert htmltext.line_blocks(lengths) == [sum(lengths[i:i + 3]) for i in range(len(lengths))]
    assert htmltext.surges(lengths, 86) == [(6, 10)]
    assert htmltext.surges(lengths, 0) == [(2, 3), (6, 10), (13, 14)]


def test_page_table(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<article>x</article>"), (2, "v", "")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    assert Counter(tuple(r) for r in htmltext.main_text(d).collect()) == Counter([(1, "u", "", 0)] * 2 + [(None, None, "x", 1), (2, "v", "", 0)])
    assert htmltext.main_text(d.limit(0)).count() == 0


# ------------------------------------------------------------------ byte-level BPE

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    tokens = bytebpe.read_ranks(RANKS)
    return bytebpe.Codec(tokens, bytebpe.PerfectHash(tokens), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    ranks = {t: i for i, t in enumerate(codec.tokens)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_the_hash_is_perfect_and_minimal(codec):
    assert all(codec.perfect.candidate(t) == i for i, t in enumerate(codec.tokens))
    assert sorted(codec.perfect.value) == list(range(len(codec.tokens)))
    keys = [f"k{i}".encode() for i in range(997)]
    small = bytebpe.PerfectHash(keys)
    assert [small.candidate(k) for k in keys] == list(range(997))


def test_encoder_is_the_library(codec, library, odd_rows):
    rng = random.Random(7)
    texts = [t or "" for _, t, *_ in odd_rows]
    texts += ["".join(chr(rng.choice([32, 10, 97, 98, 233, 0x4E2D, 0x1F600, 39, 48, 0x301, 0xA0])) for _ in range(80)) for _ in range(300)]
    texts += ["ab" * 30_000, " " * 5000, "'s't're"]
    for t in texts:
        ids = codec.encode(t)
        assert ids == library.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_encode_and_decode_tables(spark, clashing, odd_rows, library, no_docs):
    out = bytebpe.encode(clashing, RANKS, public_tokenizers.PATTERN)
    assert out.columns == [c for c in clashing.columns if c != "token_ids"] + ["token_ids"]
    back = bytebpe.decode(out, RANKS)
    for r in back.collect():
        assert r.token_ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and r.key == "mine-key"
    got = Counter(tuple(r) for r in bytebpe.round_trip(clashing, RANKS, public_tokenizers.PATTERN).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t, *_ in odd_rows:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())] += 1
    assert got == want
    assert bytebpe.round_trip(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
    assert bytebpe.encode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
