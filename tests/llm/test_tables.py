"""Operators on conversations, pages and embeddings, the registered queries and the pipeline, against brute force."""

import base64
import hashlib
import json
import os
import re
import time
import uuid
from html.parser import HTMLParser

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from profilewright.llm import chat, components, decontaminate, hamming, jaccard, language, mixing, registry, secrets, urls, warc
from tests.llm.test_texts import brute_components, brute_hits, brute_targets, corpus, near_copies

SMALL = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")


def plain(rows):
    """Sorted, floats rounded, so that row order and last digits don't matter."""
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


# --- 1: chat ---

TURNS = "conv_id long, turn long, role string, text string, block string, place string, n string"


def turns_of(spark, convs):
    """{id: [(role, text), ...]} or with own turn numbers (turn, role, text)."""
    rows = [(c, *(t if len(t) == 3 else (i, *t))) for c, ts in convs for i, t in enumerate(ts)]
    return spark.createDataFrame([(*r, "b", "p", "n") for r in rows], TURNS)


def brute_chat(convs):
    """(conv_id, turns) of conversations that are no proper prefix of another; of equal ones, the smallest id's."""
    named = {}
    for c, ts in convs:
        key = tuple(t[-2:] for t in ts)
        if key and (key not in named or (c is not None and (named[key] is None or c < named[key]))):
            named[key] = c
    return sorted(((c, k) for k, c in named.items() if not any(len(o) > len(k) and o[: len(k)] == k for o in named)), key=repr)


def line(role, text):
    return f"<|im_start|>{'unknown' if role is None else role}\n{text or ''}<|im_end|>\n"


@pytest.mark.parametrize("block", [256, 2])
def test_only_maximal_conversations_stay(spark, block):
    long = [("user" if i % 2 else "assistant", f"t{i % 3}") for i in range(40)]
    convs = [(i, long[: i + 1]) for i in range(0, 40, 3)]  # snapshots of one conversation
    convs += [(100, long[:5] + [("user", "other")]), (101, long[:5] + [("user", "other")]), (99, long[:5] + [("user", "other")])]
    convs += [(300, [("user", f"n{i % 7}") for i in range(700)]), (301, [("user", f"n{i % 7}") for i in range(699)])]  # more than a block: one row still
    convs += [(200, [("user", None)]), (201, [("user", "")]), (202, [(None, "x")]), (203, [("user", "x" * 100_000)]), (None, [("user", "null id")]), (204, [("user", "a"), ("user", "a")]), (205, [("user", "a")])]
    got = chat.render(turns_of(spark, convs).repartition(5), block).collect()
    whole = {r["conv_id"]: r for r in got}
    want = brute_chat(convs)
    assert len(got) == len(want)
    assert sorted(whole, key=repr) == sorted((c for c, _ in want), key=repr) and 205 not in whole and 100 not in whole
    for c, ts in want:
        assert whole[c]["rendered"] == "".join(line(*t) for t in ts) and whole[c]["n_turns"] == len(ts)


def test_ties_and_repeated_turns_have_an_order(spark):
    a = [(1, "user", "b"), (1, "user", "a"), (1, "user", "a"), (None, "system", "s")]
    found = [chat.render(turns_of(spark, [(1, order)])).collect() for order in (a, a[::-1], a[2:] + a[:2])]
    assert {"".join(r["rendered"] for r in rows) for rows in found} == {line("system", "s") + line("user", "a") * 2 + line("user", "b")}
    assert chat.render(turns_of(spark, [(1, a)]).filter("conv_id > 5")).count() == 0


# --- 3: URLs ---

URLS = [
    None, "", "no scheme/path", "://", "HTTP://WWW.Example.NET/EN/x", "http://example.net/en/1?x#y", "http://a.b.example.net/en/", "http://example.net/en", "http://notexample.net/en/", "http://example.com/de/a", "http://myexample.com/de/a",
    "http://sub.example.com/de", "https://x.org/fr/", "https://org/fr/1", "https://x.org?fr=/fr/", "https://net", "https://net/", "a://b://c/d", "http://É.net/é?q", "x\n://y.net/z\nw#f", "http://h.net#/", "http://" + "a" * 50_000 + ".net/" + "b/" * 50_000,
]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.match(r"[^?#]*", rest[len(host) :]).group()


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, "h", "p", "m", 1.0) for i, u in enumerate(URLS)] + [(None, URLS[5], "h", "p", "m", 1.0), (5, URLS[5], "h", "p", "m", 1.0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, match string, score double")
    got = urls.judge(pages)
    assert got.count() == len(rows) and got.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    for r in got.collect():
        host, path = brute_parts(URLS[5 if r["page_id"] is None else r["page_id"]])
        rule, verdict = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow")) and 0 <= r["score"] <= 1
    assert urls.judge(pages.filter("page_id > 100")).count() == 0


def test_the_model_judges_names_it_has_not_seen():
    """Each word's third name is held out. For words never seen the model knows little; the README has that figure."""
    table = urls.labelled_urls()
    held = table.groupby("word").cumcount() == 2
    model = urls.train(table[~held])
    p = urls.probabilities(model, list(table[held]["host"]), list(table[held]["path"]))
    assert held.sum() > 50 and np.mean((p >= 0.5) == table[held]["blocked"]) > 0.9


def brute_probability(model, host, path):
    """n-gram by n-gram, in whole numbers of any size."""
    mask, found = (1 << 64) - 1, []
    for salt, name in ((0x9E3779B97F4A7C15, host), (0xC2B2AE3D27D4EB4F, path)):
        data = f"^{name}$".encode()
        for n in model.sizes:
            for i in range(len(data) - n + 1):
                code = salt * n & mask
                for byte in data[i : i + n]:
                    code = (code ^ byte) * 0x100000001B3 & mask
                    code ^= code >> 29
                found.append((code >> (64 - model.bits - 8)) & ((1 << model.bits) - 1))
    z = sum(model.weights[b] for b in found) / max(1, len(found)) ** 0.5 + model.bias
    return 1 / (1 + np.exp(-z))


@needs_tables
def test_verdicts_equal_brute_force(spark, duck):
    """Every page's verdict: the longest rule's, else the regression worked out apart."""
    model, pages = urls.train(urls.labelled_urls()), duck.execute("SELECT page_id, url FROM pages").fetchall()
    got = {r["page_id"]: r for r in urls.op3_url_filter(spark, SMALL).collect()}
    for page, url in [*pages]:
        host, path = brute_parts(url)
        rule, verdict = brute_rule(host, path)
        p = brute_probability(model, host, path)
        assert got[page]["score"] == pytest.approx(p, abs=1e-9) and got[page]["verdict"] == (verdict or ("block" if p >= 0.5 else "allow")) and got[page]["rule"] == rule


# --- 4: search ---


def brute_top(codes, queries, k):
    out = []
    for q, code in queries:
        if code is not None:
            near = sorted((sum((x ^ y).bit_count() for x, y in zip(code, c, strict=True)), i) for i, c in codes if c is not None and i is not None)[:k]
            out += [(q, rank + 1, i, d) for rank, (d, i) in enumerate(near)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [50_000, 7])
@pytest.mark.parametrize("k", [1, 5, 400])
def test_search_is_exact(spark, block, k):
    rng = np.random.default_rng(k)
    base = rng.integers(0, 256, (40, 6), np.uint8)
    codes = [(i, bytes(base[i % 40] if i % 3 else rng.integers(0, 256, 6).astype(np.uint8))) for i in range(150)] + [(900, None), (None, bytes(base[0])), (7, bytes(base[7])), (7, bytes(base[7])), (7, bytes(base[8])), (7, bytes(255 - base[7]))]
    queries = [c for c in codes if c[0] is not None and c[0] % 10 == 0] + [(901, None), (902, bytes(255 - base[3])), (10, codes[10][1])]
    rows = spark.createDataFrame([(*c, "q", 1) for c in codes], "id long, code binary, q string, rank int")
    asked = spark.createDataFrame([(*q, "q", 1) for q in queries], "query_id long, code binary, q string, rank int")
    got = hamming.search(rows.repartition(5), asked, k, block)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_top(codes, queries, k)


def test_signs_make_codes_and_nothing_finds_nothing(spark):
    vectors = spark.createDataFrame([(1, [1.0, -1.0, 0.0, 2.0, 0.5, -3.0, 1.0, 1.0, 1.0]), (2, None), (3, [1.0]), (4, [None, float("nan"), -0.0]), (5, [])], "id long, v array<double>")
    coded = vectors.select("id", F.size("v").alias("width"), hamming.sign_code(F.col("v")).alias("code"))
    assert {r["id"]: r["code"] if r["code"] is None else bytes(r["code"]) for r in coded.collect()} == {1: bytes([0b11011001, 1]), 2: None, 3: b"\1", 4: b"\2", 5: b""}
    none = coded.filter("id > 5")
    assert hamming.search(none, none.withColumnRenamed("id", "query_id")).count() == 0
    assert hamming.search(none, coded.withColumnRenamed("id", "query_id")).count() == 0


def test_every_width_is_searched_among_its_own(spark):
    rng = np.random.default_rng(4)
    widths = [16] * 120 + [17] * 30 + [20, 0, 0, 13, 13]  # 17 to 20 have as many bytes
    rows = [(i, rng.normal(size=w).tolist()) for i, w in enumerate(widths)] + [(900, None)]
    codes = spark.createDataFrame(rows, "id long, v array<double>").select("id", F.size("v").alias("width"), hamming.sign_code(F.col("v")).alias("code"))
    got = hamming.search(codes, codes.withColumnRenamed("id", "query_id"), 3).collect()
    want = []
    for w in set(widths):
        own = [(i, np.packbits(np.array(v) > 0, bitorder="little").tobytes()) for i, v in rows if v is not None and len(v) == w]
        want += brute_top(own, own, 3)
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_lookups_return_few_codes_as_tables_grow():
    """Segments grow with the number of codes, so candidates of a radius don't grow with it."""
    rng, seen = np.random.default_rng(5), []
    for n in (1 << 10, 1 << 16):
        codes = [bytes(x) for x in rng.integers(0, 256, (n, 8), np.uint8)]
        index = hamming.Index(codes, 64)
        values, words = index.cut(codes[:200])
        seen.append(sum(len(q) for q, _, _ in index.within(values, words, np.full(200, 64), 0)) / 200 / index.segments)
    assert max(seen) < 4 and seen[1] < 2 * seen[0]


# --- 6: WARC ---

HEADERS = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Odd:  a: b \r\n\r\n"
PAGE = "<html lang='DE'><head><title>T &amp; t</title><style>x{}</style></head><body><h1>Head</h1><p>One <b>b</b>old&nbsp;x</p><script>no()</script><!-- no --><a href='/l?a=1&amp;b'>L</a></body></html>"
RESPONSES = [("<urn:1>", "http://x/é", "2024-01-01T00:00:00Z", HEADERS, PAGE), (None, None, None, None, None), ("<urn:3>", "u", "d", "", ""), ("<urn:4>", "u", "d", HEADERS, "<p>" + "word " * 100_000), ("<urn:1>", "http://x/é", "2024-01-01T00:00:00Z", HEADERS, PAGE), ("<urn:5>", "u", "d", "no colon", "<!-- open <p>x"), ("<urn:6>", "u", "d", HEADERS, "a < b & c > d")]


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_derivatives_refer_to_their_responses(spark):
    responses = spark.createDataFrame([(*r, "x") for r in RESPONSES], warc.RESPONSE_SCHEMA + ", block string")
    got = warc.derivatives(responses.repartition(3)).collect()
    assert len(got) == 2 * len(RESPONSES) and len({r["record_id"] for r in got}) == 2 * (len(RESPONSES) - 1)
    source = {r[0] or "": [x or "" for x in r] for r in RESPONSES}
    for r in got:
        _, uri, date, headers, payload = source[r["refers_to"]]
        assert (r["target_uri"], r["warc_date"], r["source_headers"]) == (uri, date, headers)
        assert r["content_length"] == len(r["block"].encode()) and r["block_digest"] == sha1(r["block"].encode()) and r["payload_digest"] == sha1(payload.encode())
        uuid.UUID(r["record_id"][10:-1])
    texts = {r["refers_to"]: r["block"] for r in got if r["warc_type"] == "conversion"}
    assert texts["<urn:1>"] == "Head\nOne bold x\nL" and texts[""] == texts["<urn:3>"] == texts["<urn:5>"] == "" and texts["<urn:6>"] == "a < b & c > d"
    assert texts["<urn:4>"] == " ".join(["word"] * 100_000)
    meta = next(r["block"] for r in got if r["warc_type"] == "metadata" and r["refers_to"] == "<urn:1>").split("\r\n")
    assert {"source-content-type: text/html", "source-x-odd: a: b", "title: T & t", "language: de", "outlink: /l?a=1&b", f"payload-digest: {sha1(PAGE.encode())}"} <= set(meta)
    assert warc.derivatives(responses.filter("target_uri = 'none'")).count() == 0


def test_records_survive_a_round_trip(spark):
    records = warc.derivatives(spark.createDataFrame([r for r in RESPONSES if r[0]][:4], warc.RESPONSE_SCHEMA))
    parsed = warc.parse("".join(r["record"] for r in warc.serialized(records).collect()).encode())
    want = {(r["record_id"], r["refers_to"], r["target_uri"], r["block_digest"], r["block"]) for r in records.collect()}
    assert {(h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Target-URI"], h["WARC-Block-Digest"], b.decode()) for h, b in parsed} == want
    carried = {r["record_id"]: (r["payload_digest"], r["source_headers"]) for r in records.collect()}
    assert {h["WARC-Record-ID"]: (h["WARC-Payload-Digest"], warc.source_headers(h.get("WARC-Source-Headers", ""))) for h, b in parsed} == carried


def test_no_field_can_be_forged(spark):
    """Line ends in links, titles, headers and targets stay inside their fields."""
    page = "<title>a\r\nlanguage: forged</title><a href='x&#13;&#10;title: forged'>l</a><a href=\"y\nz\">m</a>"
    responses = spark.createDataFrame([("<urn:1>", "http://x/\r\nWARC-Type: forged", "d\n", "HTTP/1.1 200\r\nX: a\tb\\n\r\n\r\n", page)], warc.RESPONSE_SCHEMA)
    records = warc.derivatives(responses)
    fields = [x.split(": ", 1)[0] for r in records.collect() if r["warc_type"] == "metadata" for x in r["block"].split("\r\n") if x]
    assert fields == ["payload-digest", "payload-length", "source-x", "title", "outlink", "outlink"]
    for h, _ in warc.parse("".join(r["record"] for r in warc.serialized(records).collect()).encode()):
        assert h["WARC-Target-URI"] == "http://x/ WARC-Type: forged" and h["WARC-Type"] in ("metadata", "conversion") and warc.source_headers(h["WARC-Source-Headers"]) == responses.first()["http_headers"]


@pytest.mark.parametrize("piece", ["<a ", '<a href="', "<script", "<script>", "</script ", "<!--", "<title>", "<html lang", "<head>", "<", "&#1", "<a href='x' "])
def test_a_megabyte_of_odd_markup_takes_no_time(piece):
    page, began = piece * (1_000_000 // len(piece)), time.process_time()
    warc.plain_text(page), warc.page_metadata(page)
    assert time.process_time() - began < 5  # about a second at most; quadratic ways took hours


class Reader(HTMLParser):
    """Another way to the text of a well-formed page: the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.out, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "noscript", "template", "svg", "head")
        self.out.append("\n" if tag in warc._BLOCKS and not self.off else " " if tag in ("script", "style") else "")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "noscript", "template", "svg", "head") and self.off > 0
        self.out.append("\n" if tag in warc._BLOCKS and not self.off else "")

    def handle_startendtag(self, tag, attrs):
        self.out.append("\n" if tag in warc._BLOCKS and not self.off else "")

    def handle_comment(self, data):
        self.out.append(" " if not self.off else "")

    def handle_data(self, data):
        self.out.append(data if not self.off else "")

    def text(self):
        lines = (" ".join(x.split()) for x in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x)


@needs_tables
def test_page_texts_equal_another_parser(spark, duck):
    """Every record of the query: its text by the standard library's parser, its digests and ids worked out apart."""
    pages = {warc_id(i, u): (u, h or "") for i, u, h in duck.execute("SELECT page_id, url, html FROM pages").fetchall()}
    got = warc.op6_warc_derivatives(spark, SMALL).collect()
    same = 0
    for r in got:
        url, html = pages[r["refers_to"]]
        assert r["target_uri"] == url and r["payload_digest"] == sha1(html.encode()) and r["block_digest"] == sha1(r["block"].encode()) and r["content_length"] == len(r["block"].encode())
        if r["warc_type"] == "conversion":
            reader = Reader()
            reader.feed(html), reader.close()
            same += r["block"] == reader.text()
        else:
            assert f"payload-digest: {sha1(html.encode())}\r\npayload-length: {len(html.encode())}\r\nsource-content-type: text/html; charset=utf-8\r\n" in r["block"]
    assert len(got) == 2 * len(pages) and same >= 0.98 * len(pages)


def warc_id(page, url):
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'page|{page}|{url or str()}'.encode()).hexdigest())}>"


# --- components ---


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(500, 500 + i) for i in range(1, 200)]
    loops = [(900, 901), (901, 902), (902, 900), (903, 903), (900, 901)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(chain + star + loops, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {500 + i: 500 for i in range(200)} | {900: 900, 901: 900, 902: 900}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- registered queries ---


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


@needs_tables
@pytest.mark.parametrize("name", list(registry._SQL))
def test_query_equals_its_sql(spark, duck, name):
    found = registry.queries()[name](spark, SMALL)
    columns = sorted(found.columns)
    want = duck.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({registry._SQL[name]})").fetchall()
    assert plain(map(tuple, found.select(*columns).collect())) == plain(want)


@needs_tables
def test_held_out_languages_are_predicted(spark, duck):
    langs = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = language.op2_language_id(spark, SMALL).collect()
    held = [r for r in got if r["held_out"] and langs[r["doc_id"]] is not None]
    assert len(got) == len(langs) and len(held) > 20 and np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.9


@needs_tables
def test_jaccard_query_equals_brute_force(spark, duck):
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    assert sorted((tuple(r) for r in jaccard.op9_jaccard_join(spark, SMALL).collect()), key=repr) == brute_components(rows)


@needs_tables
def test_page_queries_cover_every_page(spark, duck):
    pages = duck.execute("SELECT page_id, url FROM pages").fetchall()
    got = urls.op3_url_filter(spark, SMALL).collect()
    assert plain((r["page_id"], r["host"], r["path"], r["rule"]) for r in got) == plain((i, *brute_parts(u), brute_rule(*brute_parts(u))[0]) for i, u in pages)
    assert warc.op6_warc_derivatives(spark, SMALL).count() == 2 * len(pages)


# --- the pipeline ---


def folder_of(spark, path, rows, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_pipeline_equals_brute_force_by_stage(spark, tmp_path):
    """Each stage on what the one before kept, worked out by hand; language comes from the operator, whose accuracy is tested apart."""
    rng = np.random.default_rng(5)
    item = " ".join(rng.choice([f"w{1000 + i}" for i in range(90)], 40))
    texts = [(i, t) for i, t in corpus(5, 40) if i is not None] + [(2000 + i, t) for i, t in near_copies(6, 24, 8)]
    texts += [(5000, f"the {item} end"), (5001, "w1 password=abc123def w2 w3 w4"), (5002, "12 34 !?"), (5003, "a b c " * 4000)]
    texts = list({i: t for i, t in texts}.items())
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in texts]
    folder_of(spark, str(tmp_path), rows, [(1, item), (2, None)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    prototypes = language.learn_unheld(docs)
    judged = {r["doc_id"]: r for r in language.predict(docs, prototypes).collect()}
    left = [r for r in rows if judged[r[0]]["lang_pred"] != "und" and judged[r[0]]["score"] >= corpus_pipeline.LEAST_SCORE]
    assert 5002 not in {r[0] for r in left} and len(left) > len(rows) - 12
    first = {d: c for d, _, c in brute_components([r[:2] for r in left])}
    left = [r for r in left if first[r[0]] == r[0]]
    bad = {d for d, _, _, _, is_bad in brute_hits([r[:2] for r in left], [(1, item)]) if is_bad}
    left = [r for r in left if r[0] not in bad]
    assert bad == {5000}
    model = secrets.train()
    left = [(r[0], secrets._replaced(r[1], secrets.find_spans(r[1], model), corpus_pipeline.MARK), *r[2:]) for r in left]
    assert "[SECRET]" in dict(r[:2] for r in left)[5001] and "abc123def" not in dict(r[:2] for r in left)[5001]
    sizes = {}
    for r in left:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    want = brute_targets(sizes)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    text = {r[0]: r[1] for r in left}
    assert {r["doc_id"] for r in got} <= set(text) and all(r["text"] == text[r["doc_id"]] for r in got) and len({r["doc_id"] for r in got}) == len(got)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in mine) == min(round(want[s] + 1e-9), 3 * sizes[s])
    assert all(0 < r["taken"] <= 3 * len(text[r["doc_id"]].split()) for r in got)


def test_pipeline_stages_keep_columns_and_take_awkward_rows(spark, tmp_path):
    rows = [(None, "the dog and the cat", "en", None, 1), (1, None, None, "a", None), (2, "", "en", "a", 0), (3, "same words here today", "en", "b", 5), (3, "same words here today", "en", "b", 5), (4, "same words here today", "de", None, 5)]
    folder_of(spark, str(tmp_path), rows, [])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumns({c: F.lit("x") for c in ("key", "component_id", "words", "size", "score", "lang_pred", "guess", "found", "spans", "bad_key", "nth", "_nth", "results")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.keep_one_of_each_group(spark, docs, "").filter("doc_id in (3, 4)").count() == 1
    assert corpus_pipeline.mix_sources(spark, docs.limit(0), "").count() == 0
    assert decontaminate.decontaminate(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == len(rows)
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null" and isinstance(mixing.mix(docs).toPandas(), pd.DataFrame)


def test_pipeline_keeps_each_text_of_an_id(spark):
    """Two texts under one id both stay; of equal texts the first row by the other columns."""
    one, two = (" ".join(f"{c}{i}" for i in range(20)) for c in "xy")
    rows = [(1, one, "en", "b", 1), (1, two, "en", "b", 1), (1, two, "en", "a", 1), (1, two, "en", "a", 1), (2, one, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted(map(tuple, corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect())) == sorted([rows[0], rows[2]])


def test_pipeline_takes_columns_that_have_no_order(spark):
    one = " ".join(f"x{i}" for i in range(20))
    docs = spark.createDataFrame([(1, one, {"a": 1}, [1], (2,)), (1, one, {"b": 2}, [3], (4,)), (2, one, None, None, None), (3, "other words", {}, [], (None,))], "doc_id long, text string, m map<string, int>, l array<int>, s struct<x: int>")
    got = corpus_pipeline.keep_one_of_each_group(spark, docs.repartition(2), "")
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 3]
