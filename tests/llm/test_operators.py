"""Operators against brute force on small fixtures: nulls, empties, ties, repeats, clashing columns."""

import hashlib
import html
import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from attestor.llm import block_names, byte_bpe, components, packing, pii, quality, simhash, token_scan, url_trust, vptree, wrappers

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CLASH = ["name", "level", "cell", "fp", "marks", "_row", "kept", "length", "host_", "block", "score"]

TEXTS = [
    None, "", " \t\n", "a", "A  b\nc d", "a b c d", "Ab cd", "x" * 20000, "word " * 3000, "İSTANBUL ΣΑΣ ς é", "漢字 漢字☃",
    "it's we'll 12345", "<|endoftext|> foo", "a\u00a0b \x85 c\x1cd", "ab\n\n  c\t\td ", "a b c d", "abcd",
]


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.select("*", *[F.lit(7).alias(c) for c in CLASH]).repartition(3)


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("text").collect()]


def brute_groups(rows):
    white = re.compile("[\\x20\\x09-\\x0D]")
    groups = defaultdict(list)
    for i, t in rows:
        groups[white.sub("", t or "")].append((-len(t or ""), i is None, i if i is not None else 0, i))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}, white


@pytest.mark.parametrize("block", [3, 4096])
def test_block_names(spark, block):
    texts = TEXTS + ["abcabc", "abcab c", "ab" * 50, "ab" * 50 + "a", "ab" * 50 + " "]
    ids = [None if i == 3 else i for i in range(len(texts))]
    want, white = brute_groups(zip(ids, texts, strict=True))
    got = block_names.exact_groups(docs(spark, texts, ids), block).collect()
    assert len(got) == len(texts)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == by_sha[r.text_sha256]
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(by_sha.keys())


def test_block_names_repeats_and_empty(spark):
    df = docs(spark, ["a b", "ab", "a b", "c"], [1, 1, 1, 2])
    kept = block_names.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b"), (2, "c")]
    assert block_names.exact_groups(df.limit(0)).count() == 0


def test_block_names_share_no_name(spark):
    texts = ["".join(p) for p in itertools.product("ab", repeat=7)] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "_row bigint, _norm string")
    rows = block_names.identities(df, 2).collect()
    names = defaultdict(set)
    for r in rows:
        names[texts[r._row]].add((r.level, r.name))
    assert all(len(v) == 1 for v in names.values())
    assert len(set().union(*names.values())) == 128


def brute_fingerprint(text, shingle=4):
    words = [w for w in re.split("[\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    parts = [words[i : i + shingle] for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(" ".join(p).encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, most=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= most:
            root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(fps))]


def test_simhash_documents(spark, corpus):
    texts = TEXTS + corpus
    ids = [None if i == 5 else i for i in range(len(texts))]
    fps = [brute_fingerprint(t) for t in texts]
    want = Counter(zip(ids, (f"{f:016x}" for f in fps), brute_components(ids, fps), strict=True))
    got = simhash.near_groups(docs(spark, texts, ids))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == want
    assert simhash.near_groups(docs(spark, texts).limit(0)).count() == 0
    kept = simhash.deduplicated(docs(spark, ["a b", "a b", "c"], [4, 4, 2]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, "c"), (4, "a b")]


@pytest.mark.parametrize("bits,rows", [(16, 50_000), (8, 40), (16, 3), (56, 1)])
def test_simhash_links_of_crowded_cells(spark, bits, rows):
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        center = rng.getrandbits(64)
        fps |= {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(25)}
    fps = sorted(fps | {0, 2**64 - 1, 2**63, 15, 31})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    links = components.components(simhash.fingerprint_links(df, cell_bits=bits, cell_rows=rows)).collect()
    root = {r.node: r.root for r in links}
    got, want = defaultdict(set), defaultdict(set)
    for f, c in zip(signed, brute_components(list(range(len(fps))), fps), strict=True):
        got[root.get(f, f)].add(f)
        want[c].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, j) for j in range(200, 260)] + [(5, 5), (0, 1), (1, 0)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {n: r for n, r in got.items() if n < 60} == {n: n // 20 * 20 for n in range(60)}
    assert all(got[j] == 100 for j in range(200, 260))
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(WORDS)
    texts = TEXTS + ["foo <|endoftext|> bar", "<|startoftext|>", "a<|endoftext|><|endoftext|>b" * 90, "<|ENDOFTEXT|> <|endoftext", "word " * 600 + "<|startoftext|>é"]
    texts += corpus[:60]
    rows = packing.packed_documents(docs(spark, texts), WORDS, capacity=512).collect()
    want = []
    for i, t in enumerate(texts):
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 512)):
            cut = np.array(ids[at : at + 512], "<u4")
            want.append((i, n, at, len(cut), zlib.crc32(cut.tobytes())))
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(w[3] for w in want)
    assert len(places) <= 1.02 * -(-total // 512) + 1
    assert packing.packed_documents(docs(spark, texts).limit(0), WORDS).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(4096, np.maximum(1, rng.lognormal(6 + seed % 3, 1.2, 10 ** (1 + seed % 5)).astype(int)))
    histogram = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True))
    groups, got = packing.plan(histogram), Counter()
    for content, count in groups:
        assert count > 0 and sum(a * b for a, b in content) <= 4096
        for a, b in content:
            got[a] += b * count
    assert got == histogram
    fresh = packing.Bins(4096)
    for x in sorted(histogram, reverse=True):
        fresh.place(x, histogram[x])
    best = sum(c for held in fresh.by_gap for _, c in held)
    assert sum(c for _, c in groups) <= best + max(1, best // 400)


def test_byte_bpe(spark, corpus):
    import tiktoken

    ranks = byte_bpe.load_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert byte_bpe.PATTERN == public_tokenizers.PATTERN
    texts = TEXTS + ["a" * 5000, "ab" * 2000 + "!" * 2000, " " * 3000 + "x"] + corpus[:80]
    rows = {r.doc_id: r for r in byte_bpe.round_trip(docs(spark, texts), RANKS).collect()}
    for i, t in enumerate(texts):
        ids = np.array(own.encode_ordinary(t or ""), "<u4")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.round_trip(docs(spark, texts).limit(0), RANKS).count() == 0


@pytest.mark.parametrize("trained", [True, False])
def test_byte_bpe_small_vocabularies(trained):
    rng = random.Random(2)
    regular = 0
    for _ in range(40):
        ranks = {bytes([c]): c for c in range(256)}
        parts = [bytes([c]) for c in rng.choices(b"abc", k=300)]
        while len(ranks) < 290:
            at = rng.randrange(len(parts) - 1)
            new = parts[at] + (parts[at + 1] if trained else rng.choice(parts))
            if new in ranks or len(new) > 12:
                continue
            ranks[new] = len(ranks)
            parts = byte_bpe.merged(ranks, b"".join(parts)) if trained else [*parts, new]
        bpe = byte_bpe.ByteBpe(ranks)
        regular += bpe.regular
        for _ in range(60):
            piece = bytes(rng.choices(b"abc", k=rng.randint(1, 30)))
            want = [ranks[piece]] if piece in ranks else [ranks[p] for p in byte_bpe.merged(ranks, piece)]
            assert bpe.piece(piece) == want
    assert regular == 40 if trained else regular < 40


def test_token_scan(spark, corpus):
    texts = TEXTS + corpus[:40]
    files = token_scan.write_token_files(docs(spark, texts), RANKS)
    bpe = byte_bpe.ByteBpe(byte_bpe.load_ranks(RANKS))
    want = Counter(len(bpe.segment((t or "").encode())) for t in texts)
    for block in (1 << 20, 7, 1):
        some = files if block > 1 else files.limit(1)
        rows = token_scan.scan_token_files(some, block_tokens=block).collect()
        if block > 1:
            assert Counter(r.n_tokens for r in rows) == want
        by_file = defaultdict(list)
        for r in rows:
            by_file[r.file_no].append((r.doc_no, r.start, r.n_tokens, r.closed))
        for held in by_file.values():
            at = 0
            for n, (doc_no, start, size, closed) in enumerate(sorted(held)):
                assert (doc_no, start, closed) == (n, at, True)
                at += size + 1
    assert token_scan.token_counts(docs(spark, texts).limit(0), RANKS).count() == 0


def test_token_scan_open_end(spark, tmp_path):
    path = os.path.join(tmp_path, "t.bin")
    np.array([9, 9, 5, 9, 5, 5, 9, 9, 9], "<u2").tofile(path)
    empty = os.path.join(tmp_path, "e.bin")
    open(empty, "wb").close()
    files = spark.createDataFrame([(0, path, 18), (1, empty, 0)], "file_no bigint, path string, n_bytes bigint")
    for block in (1, 2, 4, 100):
        rows = token_scan.scan_token_files(files, end_id=5, block_tokens=block).orderBy("doc_no").collect()
        assert [tuple(r) for r in rows] == [(0, 0, 0, 2, True), (0, 1, 3, 1, True), (0, 2, 5, 0, True), (0, 3, 6, 3, False)]


def brute_spans(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def test_base_spans():
    rng = random.Random(3)
    for _ in range(20000):
        text = "".join(rng.choices("ab@@..0123456789-+ ()_%\n4é", k=rng.randint(0, 40)))
        base = pii.base_spans(text)
        assert base == brute_spans(text)
        assert all(b <= p or a >= q for _, a, b in pii.candidate_spans(text, base) for _, p, q in base)
    for text in ("a" * 200_000 + "@", "1" * 200_000, "x@" * 50_000, "9.9.9." * 30_000):
        pii.candidate_spans(text, pii.base_spans(text))


def test_personal_data_finds_unseen(spark, corpus):
    seeds = [f"please call me on +1 (555) 010-{1000 + i} after noon" for i in range(12)]
    unseen = "please call me on 555 010 7777 after noon"
    number = "version 20240101 is out"
    texts = [None, "", *seeds, unseen, unseen, number, *corpus[:50]]
    rows = {r.doc_id: r for r in pii.personal_data(docs(spark, texts)).collect()}
    at = unseen.index("555")
    assert rows[14].spans == f"phone:{at}:{at + 12}" and rows[14].n_phone == 0
    assert rows[15].spans == rows[14].spans and rows[16].spans == ""
    for i, t in enumerate(texts):
        base = brute_spans(t or "")
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert rows[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone] == [sum(k == j for k, _, _ in base) for j in range(4)]
        assert set(filter(None, told.split(","))) <= set(rows[i].spans.split(","))
    assert pii.personal_data(docs(spark, texts).limit(0)).count() == 0


def test_redaction(spark):
    texts = [None, "mail a.b@c.de now", "é +1 555 010 1234 x 10.0.0.1", "clean"]
    df = docs(spark, texts).withColumn("n_chars", F.char_length("text"))
    out = pii.redacted(df)
    assert out.columns == df.columns
    rows = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert rows == {0: (None, None), 1: ("mail [EMAIL] now", 16), 2: ("é [PHONE] x [IP]", 16), 3: ("clean", 5)}


def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = quality.classified(df).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.97
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.98
    assert quality.accepted(df).columns == df.columns


def test_quality_edges(spark):
    rows = {r.doc_id: r for r in quality.classified(docs(spark, TEXTS)).collect()}
    assert len(rows) == len(TEXTS) and rows[0].score == rows[1].score == rows[2].score
    assert quality.classified(docs(spark, TEXTS).limit(0)).count() == 0
    assert quality.vote_posteriors({}) == {}


def brute_nearest(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 3 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, a in good:
        if q % every == 0:
            far = sorted((float(np.sqrt(((a - b) ** 2).cumsum()[-1])), i) for i, b in good if i != q)[:k]
            out |= {(q, r + 1, i, d) for r, (d, i) in enumerate(far)}
    return out


@pytest.mark.parametrize("shard", [4096, 40])
def test_nearest(spark, shard):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(0, 5, 3).astype(float).tolist()) for i in range(300)]
    rows += [(None, [1.0, 2.0, 3.0]), (400, None), (401, [0.0, 0.0, 0.0]), (402, [1.0, None, 2.0]), (403, [1.0, float("nan"), 2.0]), (404, [float("inf"), 1.0, 1.0]), (500, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("cell", F.lit(1)).withColumn("v", F.lit(2))
    got = vptree.nearest(df, every=25, k=7, shard_rows=shard)
    assert {tuple(r) for r in got.collect()} == brute_nearest(rows, 25, 7)
    assert vptree.nearest(df.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:3], df.schema[:2])
    assert {tuple(r) for r in vptree.nearest(few, every=2, k=7).collect()} == brute_nearest(rows[:3], 2, 7)


def test_relaxed_tree_recall(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    exact = {(r.query_id, r.vec_id) for r in vptree.nearest(df, shard_rows=100).collect()}
    relaxed = {(r.query_id, r.vec_id) for r in vptree.nearest(df, shard_rows=100, factor=1.5).collect()}
    assert len(exact & relaxed) >= 0.9 * len(exact)


def brute_host(url):
    rest = (url or "").split("://", 1)
    if len(rest) < 2:
        return "", ""
    host = re.split("[/?#]", rest[1], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[1][len(host) :], maxsplit=1)[0]


def test_urls_and_rules(spark):
    urls = [
        None, "", "nohost/en/", "http://Example.COM/en/a?x=/es/", "https://www.example.com/en/", "https://a.www.example.com/en/b", "http://example.com",
        "http://notexample.net/es/", "http://net/es/x", "http://a.net/fr", "http://a.net?/fr/", "http://x.org/en/#://y.com/", "a://b://c.net/es/", "http://ÄB.net/es/\nx",
    ]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id bigint, url string, html string").withColumn("rule", F.lit("z"))
    for r in url_trust.judged(df).collect():
        host, path = brute_host(urls[r.page_id])
        assert (r.host, r.path) == (host, path)
        fits = [(len(h + p), h + p, v) for v, h, p in url_trust.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.rule, r.verdict) == ((max(fits)[1], max(fits)[2]) if fits else (None, "allow"))
    assert url_trust.judged(df.limit(0)).count() == 0


def test_propagation(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("d", "c", 3), ("e", "d", 1), ("b", "e", 5)]
    seeds = [("a", True, False), ("c", False, True), ("z", False, False)]
    t0, d0 = {"a": 1.0}, {"c": 1.0}
    t, d = dict(t0), dict(d0)
    out, into = Counter(), Counter()
    for s, e, n in edges:
        out[s] += n
        into[e] += n
    for _ in range(60):
        nt, nd = Counter({h: 0.15 * v for h, v in t0.items()}), Counter({h: 0.15 * v for h, v in d0.items()})
        for s, e, n in edges:
            nt[e] += 0.85 * t.get(s, 0) * n / out[s]
            nd[s] += 0.85 * d.get(e, 0) * n / into[e]
        t, d = nt, nd
    got = url_trust.propagate(spark.createDataFrame(edges, "src string, dst string, n bigint"), spark.createDataFrame(seeds, "host string, trusted boolean, blocked boolean"), rounds=12, tolerance=1e-12)
    for r in got.collect():
        assert abs(r.trust - t.get(r.host, 0)) < 0.05 and abs(r.distrust - d.get(r.host, 0)) < 0.05
    pages = [(1, "http://bad.net/es/", ""), (2, "http://who.org/", '<a href="//BAD.net:80/x">x</a>'), (3, "http://ok.org/", '<a href="/y">')]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    assert {r.page_id: r.verdict for r in url_trust.judged(df).collect()} == {1: "block", 2: "block", 3: "allow"}


def test_wrapper_induction(spark):
    def page(i, body):
        return (i, f"http://h.org/{i}", f'<html><head><title>t</title></head><body><nav>Home</nav><div class="box">Same words on all pages</div><div id="x">{body}</div><form>Ask</form><div class="comments">me too</div><footer>(c)</footer></body></html>')

    rows = [page(i, f"<p>Own <b>text</b> &amp; number {i}<br>goes\n on<p>More {i % 7}") for i in range(40)]
    rows += [(90, "http://one.org/", "<p>Alone</p>"), (91, None, None), (92, "http://h.org/e", ""), (93, "http://h.org/z", "<article><h1>A</h1><p>b <aside>no</aside>c</article><p>out"), (94, "x://h.org", "<div>" * 3000 + "deep"), (95, "x://k.org", "<" * 2000 + "p")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("blocks", F.lit(1))
    got = {r.page_id: r for r in wrappers.extracted(df, share=0.8).collect()}
    for i in range(40):
        assert got[i].text == f"Own text & number {i} goes on\nMore {i % 7}"
    assert got[90].text == "Alone" and got[91].text == "" and got[92].n_chars == 0
    assert got[93].text == "A\nb\nc" and got[94].text == "deep"
    assert wrappers.extracted(df.limit(0)).count() == 0


def test_tree_matching_is_largest():
    def tree(rng, depth):
        node = wrappers.Node(rng.choice("ab"), 0)
        node.children = [tree(rng, depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
        return node

    def number(node, at=0):
        node.number = at
        for c in node.children:
            at = number(c, at + 1)
        return at

    def best(a, b):
        if a.label != b.label:
            return 0
        m = [[0] * (len(b.children) + 1)]
        for x in a.children:
            row = [0]
            for j, y in enumerate(b.children):
                row.append(max(m[-1][j + 1], row[j], m[-1][j] + best(x, y)))
            m.append(row)
        return 1 + m[-1][-1]

    rng = random.Random(4)
    for _ in range(300):
        a, b = tree(rng, 4), tree(rng, 4)
        number(a), number(b)
        found = wrappers.align(a, b)
        assert len(found) == best(a, b) and len(set(found.values())) == len(found)


def test_pages_give_their_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in wrappers.extracted(pages).collect()}
    for r in pages.collect():
        body = re.split("</article>", r.html.split("<article>", 1)[1])[0]
        parts = (" ".join(html.unescape(re.sub("</?b>", "", p).replace("<br>", " ")).split()) for p in re.split("</?(?:p|h1)>", body))
        assert got[r.page_id] == "\n".join(p for p in parts if p)
