"""Operators on single rows, each against the library it must equal, a brute-force version or an exact round trip."""

import collections
import hashlib
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gristmill.llm import chat_tools, fingerprints, html_text, quality, queries, segmentations, token_counts, token_files, url_filters

random.seed(11)
ODD = ["", " ", "  ", "a  b", "a \n b", "\n\n", "x<|endoftext|>  y <|endoftext|>", "it's  we'll\t\x1c x \x85 \xa0 y", "é" * 50, " lead", "trail ", "a   \n", "١٢٣ abc123 -- 😀😀 x", "<|startoftext|>A b", "　x 　 y", "a\x00b", "İstanbul ÅÅ é x́", "ab ́c", "!'s -'s 1's ''s"]
LETTERS = ["<|endoftext|>", "'s", "'ll", *"-!≠́ÉÀ×ß” \n\tab,.é'1٣😀t\x1c\xa0"]
TEXTS = ODD + ["".join(random.choice(LETTERS) for _ in range(random.randrange(40))) for _ in range(1500)]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path(name)))


def test_token_counts_equal_the_library(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(9999, None), (None, "a b")]
    out = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer("byte_bpe_50k.json"), limit=20)
    got = {r["doc_id"]: r for r in out.collect()}
    for i, e in enumerate(library("byte_bpe_50k.json").encode_batch(TEXTS, add_special_tokens=False)):
        assert got[i]["n_tokens"] == len(e.ids), TEXTS[i]
        assert got[i]["n_bytes"] == len(TEXTS[i].encode()) and got[i]["over_limit"] == (len(e.ids) > 20)
    assert got[9999]["n_tokens"] == 0 and got[None]["n_tokens"] == 2
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), queries.tokenizer("byte_bpe_50k.json")).count() == 0


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 500)
    rows = [(i * 5, t) for i, t in enumerate(TEXTS)] + [(3, None), (4, "w " * 3000)]
    random.shuffle(rows)
    out = token_files.token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), queries.tokenizer("word_bpe_49k.json"))
    got = [tuple(r) for r in out.select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("doc_id").collect()]
    want, start = [], 0
    tokenizer = library("word_bpe_49k.json")
    for i, t in sorted(rows):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.token_files(spark.createDataFrame([], "doc_id long, text string"), queries.tokenizer("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("bits", [1, 8, 9, 20, 32])
def test_codes_give_any_place(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 2**bits, 5000).astype(np.uint32)
    segment = token_files.Segment(token_files.encode_segment(ids))
    places = rng.integers(0, len(ids), 300)
    assert (segment.get(places) == ids[places]).all()
    with pytest.raises(IndexError):
        segment.get(np.array([5000]))
    assert len(token_files.Segment(token_files.encode_segment(ids[:0])).get(np.empty(0, int))) == 0


class Recorder:
    """Bytes of an array, counting those that are taken."""

    def __init__(self, data, taken):
        self.data, self.taken = data, taken

    def __len__(self):
        return len(self.data)

    def __getitem__(self, at):
        out = self.data[at]
        self.taken.append(np.size(out) * self.data.itemsize)
        return out


def test_one_place_reads_as_few_bytes_of_a_long_segment_as_of_a_short_one():
    touched = []
    for n in (10**5, 10**7):
        ids = np.random.default_rng(n).integers(0, 50_000, n).astype(np.uint32)
        segment, taken = token_files.Segment(token_files.encode_segment(ids)), []
        segment.levels = [tuple(x if x is None else Recorder(x, taken) for x in level) for level in segment.levels]
        big = int(np.flatnonzero(ids > 255)[-1])
        assert segment.get(np.array([big])).tolist() == [ids[big]]
        touched.append(sum(taken))
    assert touched[0] == touched[1] < 200


PAGE = """<html><head><title>T</title><script>if (a<b) x("</p>")</script></head><body><header><a href=/>Home</a> My site</header>
<nav><ul><li><a>one</a><li><a>two</a></ul></nav><div class="cookie-notice">We use cookies to make this site better for everybody, please accept all of them right now.</div>
%s<aside><h3>Related</h3><p>Some words about another story that is not this one at all, and never was.</p></aside>
<section id="comments"><p>I think that this is a very long comment with lots of words that a reader wrote below.</p></section><form>Name <input></form><footer>&copy; 2024 all of us</footer>"""
BODY = '<h1>The   title</h1><p>First paragraph with <b>bold <a href="x?a=1&b=2">link</a> words and &amp;amp; signs<br>that go on &#233; for a while.<p>Short.</p><!-- no --><p>Last paragraph of the text with enough words to be one of its own.'
WANT = "The title First paragraph with bold link words and &amp; signs that go on é for a while. Short. Last paragraph of the text with enough words to be one of its own."


WRAPPED = [
    "<article>%s</article>",
    "<main>%s</main>",
    '<div id="content">%s</div>',
    '<div class="page no-sidebar"><article>%s</article></div>',
    '<div class="main-content comments-open"><article>%s</article></div>',
    '<article><div class="article-form-text">%s</div></article>',
    '<div class="sidebar-right layout"><div role="main">%s</div></div>',
]


@pytest.mark.parametrize("frame", WRAPPED)
def test_main_text(frame):
    assert html_text.main_texts([PAGE % (frame % BODY)]) == [WANT]


LOREM = "harbour winter signal garden copper lantern meadow river basket candle timber orchard quarry saddle velvet anchor".split()


def sentence(rng, low, high):
    return " ".join(rng.choice(LOREM) for _ in range(rng.randint(low, high))).capitalize() + "."


def held_out_page(rng, frame):
    """Blocks of a page of one of seven frames that LABELLED and the given tables don't have: (html, text, main)."""
    link = lambda n: "".join(f'<li><a href="/{i}">{rng.choice(LOREM)} {rng.choice(LOREM)}</a></li>' for i in range(n))
    body = [("h1", sentence(rng, 4, 9)[:-1])] + [("p", sentence(rng, 15, 70)) for _ in range(rng.randint(3, 9))]
    body.insert(rng.randint(2, len(body)), ("blockquote", sentence(rng, 12, 30)))
    body.insert(rng.randint(2, len(body)), ("h2", sentence(rng, 3, 6)[:-1]))
    inside = "".join(f"<{t}>{x}</{t}>" for t, x in body)
    noise = [sentence(rng, 15, 40) for _ in range(5)]
    menu, foot = f'<ul class="menu">{link(7)}</ul>', f'<div class="site-footer"><p>{noise[0]}</p><p>Copyright 2024</p></div>'
    notes = f'<div id="comments"><h3>2 comments</h3><article class="comment"><p>{noise[1]}</p></article><article class="comment"><p>{noise[2]}</p></article></div>'
    side = f'<div class="sidebar-primary"><h4>{rng.choice(LOREM)}</h4><ul>{link(5)}</ul><p>{noise[3]}</p></div>'
    frames = [
        f'<body><div class="wrap no-sidebar">{menu}<article class="post">{inside}</article>{notes}{foot}</div></body>',
        f'<body><form id="aspnetForm"><div class="top-nav">{menu}</div><div class="column">{inside}</div>{side}{foot}</form></body>',
        f'<body><table><tr><td class="navigation">{menu}</td><td>{inside}</td><td class="rail">{side}</td></tr></table>{foot}</body>',
        f'<body class="has-sidebar"><header>{menu}<p>{noise[4]}</p></header><div role="main" class="search-page comments-open">{inside}</div>{notes}{side}</body>',
        f'<body><section><div class="entry-content single-notice">{inside}</div></section><aside>{side}</aside>{notes}{foot}</body>',
        f'<body><div class="layout-sidebar"><main><div class="story-share-text">{inside}</div><div class="share-bar"><ul>{link(4)}</ul></div></main>{side}</div>{foot}</body>',
        f'<body>{menu}<div class="cookie-consent"><p>{noise[4]}</p></div><div>{inside}</div><div class="related-posts"><ul>{link(6)}</ul><p>{noise[1]}</p></div>{foot}</body>',
    ]
    return frames[frame], [x for _, x in body]


def test_held_out_frames():
    rng, hits, kept, wanted, plain = random.Random(4), 0, 0, 0, 0
    for frame in range(7):
        own = [0, 0, 0]
        for _ in range(30):
            page, body = held_out_page(rng, frame)
            found = html_text.blocks(page)
            keep = html_text.tree().predict(html_text.features(found))
            texts = {x[0] for x, k in zip(found, keep, strict=True) if k}
            hit = len(texts & set(body))
            own[0], own[1], own[2] = own[0] + hit, own[1] + len(texts), own[2] + len(body)
            plain += sum((not x[3]) == (x[0] in body) for x in found) / len(found) / 210  # by the flag of furniture alone
        assert own[0] >= 0.9 * own[1] and own[0] >= 0.9 * own[2], (frame, own)
        hits, kept, wanted = hits + own[0], kept + own[1], wanted + own[2]
    print(f"precision {hits / kept:.3f}, recall {hits / wanted:.3f}, accuracy without the tree {plain:.3f}")
    assert hits >= 0.95 * kept and hits >= 0.95 * wanted


def test_pages(spark, small):
    import re

    rows = [(1, "u", PAGE % f"<article>{BODY}</article>"), (2, None, None), (3, "v", ""), (None, "w", "<!-- open"), (5, "x", "<script>open"), (6, "y", "<p>" * 5000 + "</div>" * 5000)]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: (WANT, len(WANT)), 2: ("", 0), 3: ("", 0), None: ("", 0), 5: ("", 0), 6: ("", 0)}
    pages = spark.read.parquet(f"{small}/pages.parquet")
    texts = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    import html

    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        assert texts[r["page_id"]] == " ".join(html.unescape(re.sub(r"<[^>]*>", " \n ", inner)).split())


def test_tree_learns_its_table():
    rows = np.array([line.split() for line in html_text.LABELLED.strip().splitlines()], float)
    assert (html_text.tree().predict(rows[:, :-1]) == (rows[:, -1] > 0)).mean() > 0.97


def fingerprint_of(t):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaves = [[sha(p[i : i + 64]) for i in range(0, len(p), 64)] for p in t.split("\n")]
    pars = [sha(f"{len(x)}:" + "".join(x)) for x in leaves]
    secs, own = [], []
    for i, p in enumerate(pars):
        own.append(p)
        if p.endswith("0") or i == len(pars) - 1:
            secs.append(f"{sha(''.join(own))}:{len(own)}")
            own = []
    return "#".join([sha(" ".join(secs)), " ".join(s[:16] + ":" + s.split(":")[1] for s in secs), " ".join(f"{p[:16]}:{len(x)}" for p, x in zip(pars, leaves)), " ".join(y[:8] for x in leaves for y in x)])


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 7)
    rows = [(i * 2, "\n".join("w" * random.randrange(150) + "é😀" for _ in range(random.randrange(30)))) for i in range(50)] + [(5, None), (7, ""), (9, "x"), (200, "same\ntext"), (201, "same\ntext")]
    random.shuffle(rows)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    order = sorted((i, t or "") for i, t in rows)
    for k, (i, t) in enumerate(order):
        nxt, half = order[(k + 1) % len(order)][1], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == fingerprint_of(t) and r["edited_fingerprint"] == fingerprint_of(edited)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == t:
            assert r["near_edited"] == 1
    assert got[200]["fingerprint"] == got[201]["fingerprint"] and got[200]["near_next"] == 1


def test_fingerprint_edges(spark):
    one = lambda rows: [tuple(r)[:2] for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert one([]) == [] and one([(4, "abc")]) == [(4, 3)] and sorted(one([(4, "abc"), (4, "abc"), (None, None)]), key=str) == sorted([(4, 3), (4, 3), (None, 0)], key=str)
    pair = spark.createDataFrame([("a\nb\nc", "a\nB\nc")], "x string, y string")
    pair = fingerprints.with_fingerprint(fingerprints.with_fingerprint(pair, "x", "fx"), "y", "fy")
    assert pair.select(fingerprints.changed_paragraphs("fx", "fy")).first()[0] == [1]
    assert pair.select(fingerprints.changed_paragraphs("fx", "fx")).first()[0] == []


def test_url_filters(spark):
    entries = [("domain:bad.com", "block", "spam", "add", 10), ("domain:bad.com", "block", "spam", "remove", 20), ("domain:bad.com", "block", "spam", "add", 30), ("host:ok.bad.com", "allow", "seen", "add", 12), ("path:x.org/p", "block", "path", "add", 5), (None, "block", "z", "add", 1), ("domain:bad.com", "block", "spam", "add", None), ("domain:x.org", "block", "same", "add", 7), ("domain:x.org", "block", "same", "remove", 7)]
    urls = [(1, "http://A.bad.com/", 9), (2, "http://a.bad.com./q", 10), (3, "http://a.bad.com", 20), (4, "https://u:p@bad.com:80/x", 31), (5, "http://ok.bad.com/", 15), (6, "http://x.org/p/q?r", 6), (7, "http://x.org/pp", 8), (8, None, 9), (9, "mailto:a", 9), (10, "http://bad.com", None), (2, "http://a.bad.com./q", 10)]
    out = url_filters.judge(spark.createDataFrame(urls, "id long, u string, t long"), spark.createDataFrame(entries, "key string, verdict string, category string, action string, at long"), "id", "u", "t")
    got = sorted((r["id"], r["verdict"], r["matched"], r["active_since"]) for r in out.collect() if r["matched"]), sorted((r["id"], r["verdict"]) for r in out.collect() if not r["matched"])
    assert got[0] == [(2, "block", "domain:bad.com", 10), (2, "block", "domain:bad.com", 10), (4, "block", "domain:bad.com", 30), (5, "allow", "host:ok.bad.com", 12), (6, "block", "path:x.org/p", 5)]
    assert got[1] == [(1, "none"), (3, "none"), (7, "none"), (8, "invalid"), (9, "invalid"), (10, "none")]


def test_url_filter_ties_and_addresses(spark):
    entries = [("domain:bad.com", "block", c, "add", 1) for c in ("zzz", "aaa", "mmm")] + [("domain:0.1", "block", "net", "add", 1), ("domain:10.0.0.1", "block", "address", "add", 1), ("host:[::1]", "block", "six", "add", 1)]
    frame = spark.createDataFrame(entries, "key string, verdict string, category string, action string, at long")
    urls = [(1, "http://bad.com/"), (2, "http://10.0.0.1/x"), (3, "http://10.0.0.1:80/x"), (4, "http://[::1]:8080/"), (5, "http://[::2]/"), (6, "http://7.0.1/")]
    rows = spark.createDataFrame([(i, u, 5, "x") for i, u in urls], "id long, u string, t long, key string")
    got = {r["id"]: (r["host"], r["category"]) for r in url_filters.judge(rows, frame, "id", "u", "t").collect()}
    assert got == {1: ("bad.com", "aaa"), 2: ("10.0.0.1", "address"), 3: ("10.0.0.1", "address"), 4: ("[::1]", "six"), 5: ("[::2]", None), 6: ("7.0.1", "net")}
    assert url_filters.judge(rows, frame.where("false"), "id", "u", "t").where("verdict <> 'none'").count() == 0
    assert url_filters.judge(rows.where("false"), frame, "id", "u", "t").count() == 0


def sampled(texts, k, seeds=None):
    s = segmentations.sampler(queries.tokenizer("piece_bpe_32k.model"), 1.0)
    seeds = np.arange(len(texts)) if seeds is None else seeds
    return s, s.sample(pa.array(texts, pa.large_string()), np.asarray(seeds).astype(np.uint64) * np.uint64(977), k)


def all_segmentations(v, text):
    data, plain = (" " + text).encode(), {v.bytes_of[i]: int(i) for i in v.ids}
    out = {}

    def go(at, ids, weight):
        if at == len(data):
            out[tuple(ids)] = weight
        for n in range(1, len(data) - at + 1):
            if (i := plain.get(data[at : at + n])) is not None:
                go(at + n, [*ids, i], weight + v.weights[i])

    go(0, [], 0.0)
    total = np.logaddexp.reduce(list(out.values()))
    return {ids: w - total for ids, w in out.items()}


@pytest.mark.parametrize("t", ["the", "a b", "Hello", "  ", "a     b", "é!"])
def test_all_segmentations_come_once(t):
    s, (paths, number, open_) = sampled([t, "zz " + t], 200)
    want = all_segmentations(s.v, t)
    got = {tuple(s.lattices.piece[p.arc[p.begins[0] : p.ends[0]]].tolist()): p.log_p[0] for p in paths if p.sizes[0]}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-4 for i in got)
    assert number[0] == len(want) and open_[0] == -np.inf


def test_samples_follow_the_law_without_replacement():
    n = 20_000
    s, (paths, _, _) = sampled(["the"] * n, 2)
    p = {i: np.exp(x) for i, x in all_segmentations(s.v, "the").items()}
    seen = [collections.Counter(tuple(s.lattices.piece[q.arc[a:b]].tolist()) for a, b in zip(q.begins, q.ends)) for q in paths]
    for i in p:
        second = sum(p[j] * p[i] / (1 - p[j]) for j in p if j != i)
        assert abs(seen[0][i] / n - p[i]) < 0.015 and abs(seen[1][i] / n - second) < 0.015


def test_segmentations_round_trip(spark):
    import sentencepiece

    model = queries.tokenizer("piece_bpe_32k.model")
    rows = [(i, t) for i, t in enumerate(t for t in TEXTS if "\x00" not in t)] + [(7777, None), (8888, "word " * 2000), (8889, "ab" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = segmentations.decode(segmentations.sample_segmentations(df, model, 3), model, to="back").collect()
    texts, library = dict(rows), sentencepiece.SentencePieceProcessor(model_file=model)
    by_doc = collections.defaultdict(list)
    for r in out:
        assert r["back"] == (texts[r["doc_id"]] or "") and r["round_trip"], texts[r["doc_id"]]
        assert library.decode(r["ids"]) == r["back"]
        by_doc[r["doc_id"]].append(tuple(r["ids"]))
    assert by_doc.keys() == texts.keys() and all(len(x) == len(set(x)) for x in by_doc.values())
    again = segmentations.sample_segmentations(df.repartition(5), model, 3).collect()
    assert {(r["doc_id"], r["sample"]): r["ids"] for r in again} == {(r["doc_id"], r["sample"]): r["ids"] for r in out}
    assert segmentations.sample_segmentations(df.where("false"), model).count() == 0


def test_quality_on_held_out_labels(spark):
    out = queries.op10_quality(spark, "/root/testdata/sf0.01")
    rows = out.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_quality_learns_only_from_other_folds(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "bad### signs### here### ") * 5) for i in range(100)] + [(None, None), (500, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    # labels of the held-out fold turned round change nothing
    turned = labels.withColumn("quality", F.when(quality.fold("doc_id") == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: tuple(r) for r in quality.classify(docs, x).collect()} for x in (labels, turned))
    assert a == b and len(a) == 102
    assert all(r[3] == i % 2 for i, r in a.items() if i is not None and i < 100)
    assert all(r[1] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in a.items() if i is not None)
    empty = quality.classify(docs, labels.where("false")).collect()
    assert {r["score"] for r in empty} == {0.5}
    assert quality.classify(docs.where("false"), labels).count() == 0


def chat(spark, rows):
    schema = "conv long, turn long, role string, content string, calls array<struct<id:string,name:string,arguments:string,needs:array<string>>>, answers string"
    schemas = {"f": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}
    return chat_tools.format_chats(spark.createDataFrame(rows, schema), schemas).orderBy("conv", "turn", "json").collect()


def test_chat_links(spark):
    rows = [
        (1, 0, "assistant", None, [("c2", "f", '{"a": 2.0}', ["c1"]), ("c1", "f", '{ "a" : 1 }', None)], None),
        (1, 1, "tool", "one", None, "c1"),
        (1, 2, "tool", "again", None, "c1"),
        (1, 3, "tool", "lost", None, "c9"),
        (1, 4, "assistant", "é\"\n", [("c1", "f", '{"a":5}', []), ("c3", "f", '{"b":-1}', []), ("c4", "g", "{}", []), ("c5", "f", "{", []), (None, "f", '{"a":1}', [])], None),
        (2, 0, "assistant", "", [("x", "f", '{"a":0}', ["y"]), ("y", "f", '{"a":0}', ["x"]), ("z", "f", '{"a":0}', ["gone"])], None),
        (None, None, None, None, None, None),
    ]
    got = chat(spark, rows)
    assert [r["status"] for r in got] == [[], ["linked", "unanswered"], ["answer"], ["late"], ["orphan"], ["unnamed", "duplicate", "invalid", "invalid", "invalid"], ["unanswered", "cyclic", "cyclic"]]
    assert [r["level"] for r in got] == [None, 1, 0, 0, None, 0, 0]
    assert got[1]["json"] == '{"content":null,"role":"assistant","tool_calls":[{"answered_by":1,"arguments":{"a":1},"id":"c1","name":"f"},{"answered_by":null,"arguments":{"a":2},"id":"c2","name":"f"}]}'
    assert all(json.loads(r["json"]) is not None for r in got)
    assert got[5]["errors"] == ["$.a: required", "$.b: additionalProperties", "$: tool", "$: json"]
    assert chat(spark, []) == []


def test_levels_of_large_conversations(spark):
    calls = [(1, f"c{i}", [f"c{i // 2}"] if i else []) for i in range(40)] + [(2, "a", ["b"]), (2, "b", ["a"]), (2, "d", ["a"])]
    df = spark.createDataFrame(calls, "conv long, call string, needs array<string>")
    small, large = ({tuple(r) for r in chat_tools.topological_levels(df, most).collect()} for most in (1000, 2))
    chain = {f"c{i}": [f"c{i - 1}"] for i in range(100_000, -1, -1)}  # the last ones come first
    assert chat_tools.levels_of(chain)["c100000"] == 100_000
    assert small == large and (2, "d", None) in small and (1, "c1", 1) in small and (1, "c32", 6) in small


def test_schema_keywords():
    s = {"type": "array", "minItems": 1, "items": {"type": ["string", "null"], "maxLength": 2, "enum": ["ab", None, "abc"]}}
    assert chat_tools.violations(["ab", None], s) == []
    assert chat_tools.violations([], s) == ["$: minItems"]
    assert chat_tools.violations(["abc", 1, "x"], s) == ["$[0]: maxLength", "$[1]: type", "$[2]: enum"]
    assert chat_tools.canonical({"b": 1.0, "a": ["é", None, 0.5]}) == '{"a":["é",null,0.5],"b":1}'


PARAGRAPHS = ["The harbour office published the tide tables for the coming season on Monday morning.", "Fishers had asked for them since March, and three crews said that they would sail at once.", "The tables list every hour of high water together with the wind that is expected for it."]
WRAPPERS = (
    "comments-open-single page-with-comments reply-page discussion-page related-layout recommended-reading footer-fixed footer-sticky-layout cookie-banner-shown "
    "cookies-accepted consent-given no-sidebar has-sidebar sidebar-left comments-closed single-post"
).split()


@pytest.mark.parametrize("name", WRAPPERS)
@pytest.mark.parametrize("tag", ["article", "div"])
def test_a_class_of_the_whole_page_loses_no_article(name, tag):
    body = "<h1>Tide tables for the season</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    page = f'<html><body><div class="{name}"><nav><a href="/">Home</a> <a href="/n">News</a></nav><{tag}>{body}</{tag}></div></body></html>'
    assert html_text.main_texts([page]) == [" ".join(["Tide tables for the season", *PARAGRAPHS])]


@pytest.mark.parametrize("inner", ["div", "article"])
def test_many_comments_are_no_article(inner):
    said = "".join(f"<{inner}><p>I have sailed here for {i} years and the tables were never on time, whatever they say.</p></{inner}>" for i in range(30))
    page = f'<html><body><article><h1>Tide tables for the season</h1>{"".join(f"<p>{p}</p>" for p in PARAGRAPHS)}</article><div class="comments">{said}</div></body></html>'
    assert html_text.main_texts([page]) == [" ".join(["Tide tables for the season", *PARAGRAPHS])]


def test_a_vocabulary_whose_ids_are_not_those_of_parts_gets_whole_texts():
    texts = ["It's 12 o'clock, isn't it?  Yes!", "", "naïve ÉTÉ 漢字", "a-b c_d", " lead and trail "]
    column = pa.array(texts, pa.large_string())
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = token_files.Encoder(queries.tokenizer(name))
        ids, counts = encoder.encode(column)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [library(name).encode(t, add_special_tokens=False).ids for t in texts]
        if name == "word_bpe_49k.json":
            assert encoder.by_parts
