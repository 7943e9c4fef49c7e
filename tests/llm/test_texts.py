import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from statloom.llm import bpe, html_text, huffman, lines
from statloom.llm.chunks import ChunkCodes

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


def brute_lines(rows, min_chars=20, min_docs=3):
    strip = " \t\n\x0b\x0c\r"
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(strip).translate(fold)
    low = -(2**63)
    holders = {}
    for r in rows:
        for x in (r["text"] or "").split("\n"):
            holders.setdefault(key(x), set()).add(low if r["doc_id"] is None else r["doc_id"])
    out = []
    for r in rows:
        mine = low if r["doc_id"] is None else r["doc_id"]
        parts = (r["text"] or "").split("\n")
        keep = [x for x in parts if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and max(holders[key(x)]) != mine)]
        out.append((r["doc_id"], "\n".join(keep), len(parts), len(parts) - len(keep)))
    return Counter(out)


def test_lines_agree_with_brute_force(spark, docs, sf):
    for df in (docs, spark.read.parquet(f"{sf}/documents.parquet")):
        got = lines.dedup_lines(df, min_docs=3).collect()
        assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got) == brute_lines(df.collect())


def test_lines_of_an_empty_table_and_replaced_columns(docs, no_docs):
    assert lines.dedup_lines(no_docs).count() == 0
    got = lines.dedup_lines(docs)
    assert [c for c in got.columns if c.lower() == "n_dropped"] == ["n_dropped"] and "_dup_id" in got.columns


def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_agrees_with_tiktoken_and_round_trips(spark, docs, sf):
    enc = tiktoken_encoding()
    for df in (docs, spark.read.parquet(f"{sf}/documents.parquet")):
        for r in bpe.encode_and_decode(df, RANKS, public_tokenizers.PATTERN).collect():
            ids = enc.encode_ordinary(r["text"] or "")
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
            assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_bpe_on_odd_strings():
    enc, codec = tiktoken_encoding(), bpe.codec(RANKS, public_tokenizers.PATTERN)
    rng = np.random.default_rng(3)
    cases = []
    alphabet = list("ab  \n\n\t'sS1٣é,.!☃😀\u00a0\u2028\u1680\x1c\x85\u058b\u0c5c漢字")
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 14)))
        ids = enc.encode_ordinary(text)
        cases.append((text, ids))
    cases += [("a" * 20_000, enc.encode_ordinary("a" * 20_000)), (None, [])]
    for size in (1 << 12, 20 << 20):  # with and without room to remember
        codes = ChunkCodes(codec.ids, "<u4", size)
        for at in range(0, len(cases), 200):
            part = cases[at : at + 200]
            flat, n = codes(pa.array([text for text, _ in part]))
            for (text, ids), got in zip(part, np.split(flat, np.cumsum(n)[:-1])):
                assert got.tolist() == ids, repr(text)
                assert codec.decode(got.tobytes()) == (text or "").encode()


def test_bpe_of_an_empty_table_and_a_poor_vocabulary(no_docs):
    assert bpe.encode_and_decode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.Codec({b"a": 0}, public_tokenizers.PATTERN)


@pytest.mark.parametrize("counts", [[], [0, 0], [0, 5, 0], [1, 1], [1, 2, 4, 8, 16, 32, 64, 128, 256], [3] * 40])
def test_code_lengths_fill_the_code_space(counts):
    lengths = huffman.code_lengths(np.array(counts, dtype=np.int64), 6)
    used = [int(x) for x in lengths if x]
    assert len(used) == sum(c > 0 for c in counts) and max(used, default=0) <= 6
    assert sum(2.0**-x for x in used) == (1 if len(used) > 1 else 0.5 * len(used))


def test_packed_ids_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 127, 128, 129, 5000):
        ids = rng.zipf(1.3, n) % 300
        lengths = huffman.code_lengths(np.bincount(ids, minlength=300), 12)
        bits, payload, marks = huffman.pack(ids, lengths, huffman.canonical(lengths))
        assert len(payload) == (bits + 7) // 8
        assert (huffman.unpack(n, payload, marks, huffman.decode_table(lengths)) == ids).all()


def test_token_files_agree_with_the_library(spark, docs, no_docs, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    special = spark.createDataFrame([(3, "a <|endoftext|> b"), (1, "<|endoftext|>"), (2, "x<|endoftext|>y  <|endoftext|>")], "doc_id long, text string")
    for df in (docs, spark.read.parquet(f"{sf}/documents.parquet"), no_docs, special):
        folder = huffman.store_ids(df, JSON)
        want = [(r["doc_id"], [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in df.collect()]
        got = sorted(huffman.read_ids(spark, folder).collect(), key=lambda r: r["start"])
        assert [r["doc_id"] for r in got] == sorted((d for d, _ in want), key=lambda d: (d is not None, d))
        have = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got]
        assert sorted(map(repr, have)) == sorted(map(repr, want))
        starts = np.cumsum([0, *(len(x) for _, x in have)])[:-1]
        assert [r["start"] for r in got] == starts.tolist()
        crc = {r["start"]: r["ids_crc32"] for r in huffman.read_digests(spark, folder).collect()}
        assert crc == {int(s): zlib.crc32(np.array(x, "<u4").tobytes()) for s, (_, x) in zip(starts, have)}


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home page of all things</a></ul></nav>
<header class="top">Site name</header><div class="ad">Buy this now, it is a very long advert text indeed.</div>
<div id="content"><h1>Head &amp; more</h1><p>First  para<b>graph</b> with some words in it.<p>Second &eacute; one, a bit longer than the first.
<script>var a = "</p><p>not text";</script><form><input><p>Name</form><ul><li>item one<li>item two</ul></div>
<div class="comments"><p>A reader says a lot of things here, more than the article does, and goes on for long.</p></div>
<footer>&copy; somebody</footer></body></html>"""


def test_main_text_of_pages(spark):
    want = "Head & more\nFirst paragraph with some words in it.\nSecond é one, a bit longer than the first.\nitem one\nitem two"
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<div><script>x</script></div>") == ""
    assert html_text.main_text("no  markup &lt; here") == "no markup < here"
    assert html_text.main_text("<div>" * 5000 + "deep text" + "</div>" * 5000) == "deep text"
    assert html_text.main_text("a < b <p 'unclosed <b>c") != ""
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, None)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.extract_text(df).collect()}
    assert got[1]["text"] == want and got[1]["n_chars"] == len(want) and got[2]["text"] == ""
    assert html_text.extract_text(df.where("false")).count() == 0


def test_main_text_is_the_article_of_every_test_page(spark):
    import html
    import re

    for r in html_text.extract_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(x for x in parts if x)


def paragraphs(*sizes):
    text = " ".join(f"word{i}" for i in range(300))
    return [text[:n].strip() for n in sizes]


def tagged(lines):
    return "".join(f"<p>{x}</p>" for x in lines)


@pytest.mark.parametrize("menu", ["", "<div><a href=a>One link of the menu</a> <a href=b>Another link of the menu</a></div>"])
@pytest.mark.parametrize("outer", ["article", "main", "div"])
def test_main_text_keeps_the_article_around_its_densest_part(outer, menu):
    around = lambda x: f"<body>{menu}<{outer}>{x}</{outer}>{menu}</body>"
    lead, many = paragraphs(200), paragraphs(*[400] * 20)
    assert html_text.main_text(around(f"<h1>Head</h1>{tagged(lead)}<div>{tagged(many)}</div>")) == "\n".join(["Head", *lead, *many])
    first, second = paragraphs(*[500] * 10), paragraphs(500, 500, 60)
    page = f"<section><h2>A</h2>{tagged(first)}</section><section><h2>B</h2>{tagged(second)}</section>"
    assert html_text.main_text(around(page)) == "\n".join(["A", *first, "B", *second])
    short, linked = "A short word first.", "See <a href=x>the first long link</a> and <a href=y>the second long link</a>."
    page = f"<p>{short}</p><div>{tagged(many)}</div><p>{linked}</p><p>{lead[0]}</p>"
    want = [short, *many, "See the first long link and the second long link.", *lead]
    assert html_text.main_text(around(page)) == "\n".join(want)


@pytest.mark.parametrize("inside, want", [
    ('<p class="notice">x<p>One</p><p>Two</p>', "One\nTwo"),
    ('<p class="notice">x <b>y</b><div>One</div><p class="ad">z</p><p>Two</p>', "One\nTwo"),
    ('<ul><li>One<li class="ad">x<ul><li>y<li>z</ul>x<li>Two</ul><p>Three</p>', "One\nTwo\nThree"),
    ('<ul><li>One</li><li class="ad">x<div><p>y</div>z</li><li>Two</li></ul><p>Three</p>', "One\nTwo\nThree"),
    ('<ul><li class="ad">x</ul><p>One</p>', "One"),
    ('<dl><dt class="ad">x<dd>One<dd class="ad">y<dt>Two<dd>Three</dl>', "One\nTwo\nThree"),
    ('<table><tr><td class="ad">x<table><tr><td>y</table>x<td>One<tr class="ad"><td>z<td>z<tr><th class="ad">x<tr><td>Two</table><p>Three</p>', "One\nTwo\nThree"),
    ('<table><tbody class="ad"><tr><td>x<tbody><tr><td>One</table><p>Two</p>', "One\nTwo"),
    ('<p class="ad">x<svg><p>y</p></svg><script>"<p>"</script>z<!-- <p> --></p><p>One</p>', "One"),
    ('<div><p class="ad">x</div><p>One</p>', "One"),
])
def test_left_out_end_tags_of_unwanted_parts(inside, want):
    assert html_text.main_text(f"<body><article>{inside}</article></body>") == want


def test_digests_are_those_of_the_library():
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    assert hashlib.sha256(codec.decode(codec.encode("été\n\n x"))).hexdigest() == hashlib.sha256("été\n\n x".encode()).hexdigest()
    assert base64.b64decode("YQ==") in codec.ranks


def test_names_mark_a_part_only_as_a_whole():
    for name in ("ad", "ad-slot", "comment-list", "comments", "post-comments", "sidebar-left", "sidebarLeft", "shareButtons", "site-header",
                 "comment-42", "main-menu", "related-articles", "cookie-notice", "entry-footer"):
        assert html_text.unwanted_name(name), name
    for name in ("share-price", "related-work", "legal-basis", "post-header", "article-header", "section-banner", "hidden-gems", "adult", "lead", "42", "-"):
        assert not html_text.unwanted_name(name), name
    text = "A sentence that goes on for long enough to count as article text, with some more words behind it. " * 3
    want = "\n".join(["Head", text.strip(), "Basis of it", text.strip()])
    inside = f"<h1>Head</h1><p class='related-work'>{text}</p><p id='legal-basis'>Basis of it</p><p>{text}</p>"
    assert html_text.main_text(f"<body><div class='share-price'><article>{inside}<div class='ad-slot'>buy</div></article></div></body>") == want


def test_a_form_around_the_page_is_a_container():
    text = "A sentence that goes on for long enough to count as article text, with some more words behind it. " * 3
    body = f"<h1>Head</h1><p>{text}</p><p>{text}</p>"
    want = "\n".join(["Head", text.strip(), text.strip()])
    field = "<form><label>Your name and a long explanation of what it is for</label><input name=n><button>Send</button></form>"
    for page in (f"<form id='aspnetForm'><nav>menu</nav><div>{body}</div><input type=hidden></form>", f"<form><article>{body}</article></form>",
                 f"<article>{body}{field}</article>", f"<div>{body}</div>{field}", f"<form><form><article>{body}</article></form>{field}"):
        assert html_text.main_text(f"<html><body>{page}</body></html>") == want, page
    assert html_text.main_text(f"<body>{field}</body>") == ""


def test_words_of_earlier_tasks_are_not_encoded_again(monkeypatch):
    texts = pa.array(["some words come back", None, "words come back again"])
    first = [x.tolist() for x in huffman._text_ids(JSON)(texts)]
    monkeypatch.setattr(huffman._text_ids(JSON).codes, "encode", lambda text: pytest.fail(text))
    assert [x.tolist() for x in huffman._text_ids(JSON)(texts)] == first
    assert [x.tolist() for x in huffman.TextIds(JSON)(texts)] == first
