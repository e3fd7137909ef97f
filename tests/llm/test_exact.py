"""Operators against brute-force versions on small tables with odd rows."""

import gzip
import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quill.llm import common, html, lines, mixing, pieces, pii, quality, queries, shards, simhash, warc, weighted
from tests.llm.helpers import (DOCS, PAGES, WORD, brute_components, brute_lines, brute_quality, brute_simhash, doc,
                               good_docs, odd_docs, sha)

CASES = {"odd": odd_docs, "good": good_docs}


@pytest.fixture(params=list(CASES))
def docs(spark, request):
    rows = CASES[request.param]()
    return spark.createDataFrame(rows, DOCS).repartition(3), [(r[0], r[1], r[3]) for r in rows]


def test_line_dedup(docs):
    df, rows = docs
    want = Counter((d, n, gone, sha(t)) for (d, _, _), (t, n, gone) in zip(rows, brute_lines([r[:2] for r in rows]), strict=True))
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.line_dedup(df).collect())
    assert got == want


def test_perfect_hash_is_minimal():
    import numpy as np
    h = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.int64).view(np.uint64)
    levels = lines.build_mph(h)
    assert sorted(lines.probe_mph(levels, h).tolist()) == list(range(5000))
    row = lines.pack_shard(h, h.view(np.int64), h.view(np.int64) % 7, h.view(np.int64))
    again = lines.unpack_levels(row["sizes"], row["bits"])
    at = lines.probe_mph(again, h)
    assert (np.frombuffer(row["fps"], np.int64)[at] == h.view(np.int64)).all()


def test_quality(docs):
    df, rows = docs
    got = {(r.doc_id, r.n_words, r.word_chars): r for r in quality.quality_rules(df).collect()}
    for d, t, _ in rows:
        b = brute_quality(t)
        r = got[d, b[0], b[1]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == b
        assert not (r.base_failed and r.kept)


def test_quality_keeps_prose_and_rejects_junk(spark):
    df = spark.createDataFrame(good_docs() + [doc(1000, "*** ### $$$ word " * 100), doc(1001, " ".join(f"ZQX{i}" for i in range(99)))], DOCS)
    kept = {r.doc_id for r in quality.quality_rules(df).filter("kept").collect()}
    assert kept == {d[0] for d in good_docs()}


def test_quality_keeps_very_long_documents(spark):
    text = "\n".join(" ".join(f"word{i}" if i % 10 else "the" for i in range(k, k + 100)) for k in range(0, 1_000_100, 100))
    df = spark.createDataFrame([doc(1, text), doc(2, text + " ###" * 200_000)], DOCS)
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert got[1].n_words == 1_000_100 and got[1].kept and not got[2].kept


def test_sentencepiece_equals_library(docs):
    import public_tokenizers
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECE_MODEL))
    df, rows = docs
    want = Counter()
    for d, t, _ in rows:
        ids = lib.encode(t or "")
        want[d, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)), tuple(ids)] += 1
    got = pieces.encode_table(df, queries.piece_model(), with_ids=True).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in got) == want


def test_sentencepiece_random_texts():
    import public_tokenizers
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECE_MODEL))
    encoder = pieces.Encoder(pieces.PieceModel(queries.piece_model()))
    r = random.Random(2)
    bits = ["a", "e", "th", " ", "  ", "\n", " \n ", "the", "ing", "é", "漢", "😀", "▁", "aaaa", "0", "<s>", "\t", "̀", "\x00", "=-", "...."]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 50))) for _ in range(3000)] + ["a" * 400, " " * 70, "=-" * 90]
    for t, (n, ids, text) in zip(texts, encoder.texts(texts), strict=True):
        want = lib.encode(t)
        assert (n, ids, text) == (len(want), ",".join(map(str, want)), lib.decode(want))
        assert encoder.model.decode(want) == text


def test_simhash(docs):
    df, rows = docs
    prints = [brute_simhash(t) for _, t, _ in rows]
    comp = brute_components(prints)
    low = defaultdict(list)
    for (d, _, _), c in zip(rows, comp, strict=True):
        if d is not None:
            low[c].append(d)
    want = Counter((d, f"{p:016x}", min(low[c]) if low[c] else None) for (d, _, _), p, c in zip(rows, prints, comp, strict=True))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_dedup(df).collect())
    assert got == want


@pytest.mark.parametrize("tree_nodes", [20, simhash.TREE_NODES])
def test_bk_links_connect_a_large_cluster(spark, tree_nodes):
    """A shard far above the tree size is cut into trees and loses no link."""
    r = random.Random(4)
    base = r.getrandbits(64)
    prints = {base}
    while len(prints) < 300:
        x = base if r.random() < 0.7 else r.getrandbits(64)
        for _ in range(r.randint(0, 7)):
            x ^= 1 << r.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4)
    links = simhash.near_links(df, tree_nodes=tree_nodes)
    nodes = {r.node: r.root for r in common.connected_components(links).collect()}
    comp = brute_components(prints)
    got = [nodes.get(x, x) for x in signed]
    same = lambda c: [[i for i, y in enumerate(c) if y == x] for x in c]
    assert same(got) == same(comp)
    assert links.count() < 15 * 300 * 20


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5)]
    random.Random(1).shuffle(edges)
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in common.connected_components(df).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1400)}
    assert common.connected_components(df.limit(0)).count() == 0


def test_sharding(docs):
    df, rows = docs
    got = shards.interleave(df).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    counts = [sizes.get(s, 0) for s in range(40)]
    assert max(counts) - min(counts) <= 1 and set(sizes) <= set(range(40))
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "rows", None) for d, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got) == want


def test_sharding_keeps_the_mixture(spark):
    rows = [doc(i, f"t{i}", "big" if i % 10 < 6 else "mid" if i % 10 < 9 else "low") for i in range(4000)]
    got = shards.interleave(spark.createDataFrame(rows, DOCS)).collect()
    for s in range(40):
        c = Counter(r.source for r in got if r.shard == s)
        assert abs(c["big"] - 60) <= 2 and abs(c["mid"] - 30) <= 2 and abs(c["low"] - 10) <= 2
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order != sorted(order)


def targets(sizes):
    """Resharing round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        den = sum(w[s] for s in names if s not in capped)
        t = {s: 3.0 * sizes[s] if s in capped else w[s] * rest / den for s in names}
        over = {s for s in names if s not in capped and t[s] > 3 * sizes[s]}
        if not over:
            return t
        capped |= over


@pytest.mark.parametrize("make", [odd_docs, good_docs, lambda: [doc(i, "w " * (i % 50), f"s{min(i % 97, 5)}") for i in range(3000)]])
def test_mixing(spark, make):
    rows = make()
    got = mixing.fair_queue(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    t = targets(sizes)
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter(
        (r[0], len(WORD.findall(r[1] or "")), sizes[r[3]]) for r in rows)
    by = {(sizes[s], round(t[s], 6)) for s in sizes}
    assert {(r.source_size, round(r.target, 6)) for r in got} <= by
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert sum(r.taken for r in got) <= sum(sizes.values())
    if len(rows) == 3000:
        for s in sizes:
            mine = [r for r in got if (r.source_size, round(r.target, 6)) == (sizes[s], round(t[s], 6))]
            assert abs(sum(r.taken for r in mine) - t[s]) <= 100
        df = spark.createDataFrame(rows, DOCS)
        copies = Counter(r.doc_id for r in mixing.mix(df).collect())
        assert copies == Counter({r.doc_id: r.taken // r.size for r in got if r.taken})


def test_pii_base_spans_follow_the_patterns():
    import re
    r = random.Random(5)
    bits = ["a", "b@", "@", "c.d", ".", "_", "-", "+", "1", "23", "4.5", " ", "(", ")", "4111111111111111", "x@y.z", "1.2.3.4",
            "+1 (555) 123-4567", "é", "300.1.1.1"]

    def brute(t):
        out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
                if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = pii.digits_of(m[0])
            if 13 <= len(d) <= 19 and pii.luhn(d):
                out.append(("card", m.start(), m.end()))
        out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
                if 9 <= len(pii.digits_of(m[0])) <= 15]
        return out
    for _ in range(5000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(t) == brute(t)


def test_pii_trees_on_held_out_spans():
    models = pii.trained()
    right = wrong = missed = 0
    for kind, text, a, b, good in pii.labelled(1500, seed=99):
        _, added = pii.all_spans([text], models)[0]
        hit = any(k == kind and x < b and a < y for k, x, y in added)
        right += hit and good
        wrong += hit and not good
        missed += good and not hit
    assert right > 500 and wrong <= 0.03 * right and missed < 0.05 * (right + missed)


def test_pii_table(docs):
    df, rows = docs
    models = pii.trained()
    want = Counter()
    for d, t, _ in rows:
        base, added = pii.all_spans([t or ""], models)[0]
        k = [s[0] for s in base]
        want[d, k.count("email"), k.count("ip"), k.count("card"), k.count("phone"), sha(pii.joined(base)), pii.joined(base + added)] += 1
    assert Counter(tuple(r) for r in pii.find_pii(df).collect()) == want


def test_pii_windows_are_all_proposed():
    import re
    r = random.Random(6)
    bits = ["1", "234", "5678", "(555)", "4111111111111111", "12345678901234567890", " ", ", ", "-", " - ", "a", "+", "    "]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 16)))
        groups = [m.span() for m in re.finditer(r"[0-9]+", t)]
        want = set()
        for i, (a, _) in enumerate(groups):
            for j in range(i, len(groups)):
                if j > i and not re.fullmatch(r"[ ().,_/-]{1,3}", t[groups[j - 1][1]:groups[j][0]]):
                    break
                n = len(pii.digits_of(t[a:groups[j][1]]))
                if 7 <= n <= 15:
                    want.add(("phone", a - (t[max(0, a - 1):a] in ("(", "+")), groups[j][1]))
                if 13 <= n <= 19:
                    want.add(("card", a, groups[j][1]))
        got = list(pii.windows(t))
        assert len(got) == len(set(got)) and set(got) == want


def test_pii_beside_other_numbers():
    models = pii.trained()
    for text, want in (("call 555-123-4567, 555-987-6543 now", ["555-123-4567", "555-987-6543"]),
                       ("in 2023 (555) 123-4567", ["(555) 123-4567"]), ("10.0.0.1, (555) 123-4567", ["(555) 123-4567"]),
                       ("x 7536784127813050 4845168114407329 y", ["7536784127813050", "4845168114407329"]),
                       ("to +1 (826) 555-4081 190.137.223.204 at", ["+1 (826) 555-4081"]),
                       ("on 2023-05-17 the 12, 13, 14, 15, 16 of 1,299.00", [])):
        _, added = pii.all_spans([text], models)[0]
        assert sorted(text[a:b] for _, a, b in added) == sorted(want)


def test_pii_neighbours_on_held_out_texts():
    models = pii.trained()
    exact = false = missed = 0
    for _, text, _, true in pii.examples(1500, seed=98):
        base, added = pii.all_spans([text], models)[0]
        exact += sum(s in true for s in added)
        false += sum(s not in true for s in added)
        missed += sum(s not in added and s not in base for s in true)
    assert exact > 500 and false <= 0.03 * exact and missed < 0.1 * exact


def test_pii_many_numbers_in_one_text():
    models = pii.trained()
    parts = [f"call 555-123-{i:04}, 555-987-{i:04} or" for i in range(1500)]
    _, added = pii.all_spans([" ".join(parts)], models)[0]
    assert len(added) > 2900


def test_weighted_collisions_follow_generalised_jaccard():
    a, b = "x x x y y z " + "u " * 9, "x y y y z w " + "u " * 4
    ca, cb = Counter(a.split()), Counter(b.split())
    truth = sum((ca & cb).values()) / sum((ca | cb).values())
    s = weighted.signatures([a, b, "", " ", a], 4096)
    assert abs((s[0] == s[1]).mean() - truth) < 0.03
    assert (s[0] == s[4]).all() and not s[2].any() and not s[3].any()


def test_weighted_keys_follow_the_formula_in_small_buffers():
    n = 4 * weighted.KEY_ROWS + 3
    term, weight = np.arange(1, n + 1, dtype=np.uint64) * weighted.STEP, np.arange(n) % 7 + 1
    tracemalloc.start()
    try:
        got = weighted.sample_keys(term, weight)
        peak = tracemalloc.get_traced_memory()[1] - got.nbytes
    finally:
        tracemalloc.stop()
    assert peak < 2 << 20

    def mix(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> shift)) * factor % (1 << 64)
        return x ^ (x >> 31)

    for i, k in ((0, 1), (7, 64), (n - 1, 33)):
        hashes = [mix((int(term[i]) + k * int(weighted.STEP)) % (1 << 64))]
        while len(hashes) < 3:
            hashes.append(mix((hashes[-1] + int(weighted.STEP)) % (1 << 64)))
        u = [((x >> s) % (1 << 32) + 0.5) / (1 << 32) for x in hashes for s in (32, 0)]
        r, c, b = -math.log(u[0] * u[1]), -math.log(u[2] * u[3]), u[4]
        t = math.floor(math.log(weight[i]) / r + b)
        bits = int(np.float32(math.log(c) - r * (t - b) - r).view(np.uint32))
        order = bits ^ (0xFFFFFFFF if bits >> 31 else 1 << 31)
        key = int(got[i, k - 1])
        assert abs((key >> 32) - order) <= 1  # the logarithms may differ by a last place
        assert key % (1 << 32) == mix(hashes[2] ^ (t * int(weighted.STEP)) % (1 << 64)) >> 32


def test_weighted_table(docs):
    df, rows = docs
    order = sorted(((weighted.LAST if d is None else d), t or "", d) for d, t, _ in rows)
    want = Counter()
    for i, (_, t, d) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        e = weighted.edited_text(t, nxt)
        sig = weighted.signatures([t, e, nxt])
        hexes = weighted._hex(sig)
        has = [bool(WORD.search(x)) for x in (t, e, nxt)]
        like = [(sig[0] == sig[j]).mean() if has[0] and has[j] else float(has[0] == has[j]) for j in (1, 2)]
        want[d, len(t), sha(e), hexes[0], hexes[1], *like] += 1
    for rows_a_block in (2, weighted.BLOCK_ROWS):
        old, weighted.BLOCK_ROWS = weighted.BLOCK_ROWS, rows_a_block
        try:
            assert Counter(tuple(r) for r in weighted.weighted_fingerprints(df).collect()) == want
        finally:
            weighted.BLOCK_ROWS = old


# --- pages --------------------------------------------------------------------------------------

def page(i, url, html_text):
    return (i, url, html_text, "d", 1, "h")


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é " + "x" * 1200
    rows = [page(1, "http://a/1", big), page(2, None, big), page(3, "http://a/3", big), page(4, "http://b/\r\nx", None),
            page(5, "http://b/5", ""), page(6, "u", "short"), page(7, "u", "short"), page(7, "u", "short"),
            page(None, "u", "line\nline\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), page(8, "u", "y" * 300_000), page(3, "u", big)]
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    got = warc.archive_pages(df, f"file://{tmp_path}/w").collect()
    want = Counter()
    for i, _, h, *_ in rows:
        p = (h or "").encode()
        again = h == big and i != 3
        want[i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", 3 if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    # every sidecar entry is a member of its own in the real file
    for r in got:
        data = open(r.file.removeprefix("file:"), "rb").read()
        head, block = warc.read_record(data, r.offset, r.length)
        assert head["warc-type"] == r.record_type
        if r.record_type == "response":
            assert hashlib.sha1(block.partition(b"\r\n\r\n")[2]).hexdigest() == r.payload_digest
    whole = b"".join(gzip.open(f).read() for f in (tmp_path / "w/members").glob("*.txt"))
    raw = b"".join(gzip.open(f).read() for f in (tmp_path / "w/raw").glob("*.gz"))
    assert Counter(whole.split(b"WARC/1.1")) == Counter(raw.split(b"WARC/1.1"))


def test_warc_broken_stream():
    cutter = warc.RecordCutter()
    for line in (b"WARC/1.1\r", b"Content-Length: 5\r", b"\r"):
        assert cutter.feed(line) is None
    with pytest.raises(ValueError):
        cutter.end()


PAGE = ("<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='<p>x</p>';</script></head><body>"
        "<header><h1>Site</h1></header><nav><ul><li><a href=/x>Menu</a><li>More</ul></nav>{tmpl}<article><h1>A &amp; B {n}</h1>"
        "<p><b>First   line {n}<br><p>Second\n line &lt;3 é<ul><li>one<li>two</ul><div class='share-bar'>tweet</div>"
        "<aside>side</aside><form><input value=1>go</form></article><div id=comments>me too</div><footer>&copy;</footer>")


def test_html_text(spark):
    tmpl = "<div class=x><p>Welcome to the site</p><span>of all things</span></div>"
    rows = [page(i, f"http://Host.example:80/{i}?a#b", PAGE.format(tmpl=tmpl, n=i)) for i in range(8)]
    rows += [page(100 + i, "http://plain.example/", f"<body>{tmpl}<p>Own text {i}<p>Tail {i}") for i in range(8)]
    rows += [page(200, "http://single.example/", f"<body>{tmpl}<p>Own"), page(201, None, None), page(202, "x", ""),
             page(203, "u", "a < b & c <"), page(204, "u", "<p>cut <a href='x")]
    got = {r.page_id: r for r in html.extract_pages(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    for i in range(8):
        assert got[i].text == f"A & B {i}\nFirst line {i}\nSecond line <3 é\none\ntwo"
        assert got[100 + i].text == f"Own text {i}\nTail {i}"
    assert got[200].text == "Welcome to the site\nof all things\nOwn"
    assert got[201].text == "" and got[202].text == "" and got[203].text == "a < b & c <" and got[204].text == "cut"
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_html_shared_article_passages_stay(spark):
    rows = [page(i, "http://h.example/", f"<body><article><p>Shared passage of all</p><p>Own {i}</p></article>") for i in range(20)]
    for r in html.extract_pages(spark.createDataFrame(rows, PAGES)).collect():
        assert r.text == f"Shared passage of all\nOwn {r.page_id}"


def test_html_boxes_inside_articles_go(spark):
    box = "<div class='who-wrote'><p>By Ann, who writes about <b>things</b></p><ul><li>Follow her</ul></div>"
    head, shared = "<h2 class=t>Introduction</h2>", "<p class=lead>Shared passage of all</p><div><p>and bare boxes</p></div>"
    rows = [page(i, "http://h.example/", f"<body><article>{head}<p>Own {i}</p>{box}{shared}</article>") for i in range(20)]
    # copies of one article: its boxes recur with it only; and a box on fewer pages than a template has
    rows += [page(100 + i, "http://copies.example/", "<article><div class=a><p>One</p></div><div class=b><p>Two</p></div>"
                  "<div class=c>Three</div></article>") for i in range(20)]
    rows += [page(200 + i, "http://few.example/", f"<article><p>Own {i}</p>{box if i < 3 else ''}</article>") for i in range(20)]
    # a box that is most of the text stays
    rows += [page(300 + i, "http://most.example/", f"<main><p>{i}</p><div class=body>All of the text of this page</div></main>")
             for i in range(20)]
    for r in html.extract_pages(spark.createDataFrame(rows, PAGES).repartition(3)).collect():
        i = r.page_id % 100
        want = {0: f"Introduction\nOwn {i}\nShared passage of all\nand bare boxes", 1: "One\nTwo\nThree",
                2: f"Own {i}" + "\nBy Ann, who writes about things\nFollow her" * (i < 3),
                3: f"{i}\nAll of the text of this page"}[r.page_id // 100]
        assert r.text == want


def text_of(html_text):
    root = html.parse(html_text)
    html.hash_subtrees(root)
    return html.main_text(root, set())


def test_html_wrappers_of_the_main_content_stay():
    art = "<article><h1>T</h1><p>Own text</p></article>"
    for wrapped in (f"<div class='layout has-sidebar'>{art}</div>", f"<div id='page-header-fixed'>{art}</div>",
                    f"<form action=/x>{art}<input></form>", f"<div class='page sidebar'>{art}</div>", f"<aside>{art}</aside>",
                    f"<div role=search><div class=menu>{art}</div></div>", f"<header>{art}</header>"):
        for around in ("{}", "<body><nav>Menu</nav>{}<div class=sidebar>Other</div><footer>f</footer>"):
            assert text_of(around.format(wrapped)) == "T\nOwn text", wrapped
    # without article or main: what holds most of the text
    for start, end in (("<form>", "</form>"), ("<div class=sidebar>", "</div>"), ("<div class='has-sidebar'>", "</div>")):
        assert text_of(f"<body><nav>A long menu of this site</nav>{start}<p>Own text of the page{end}<div class=menu>Go</div>") \
            == "Own text of the page"
    assert text_of(f"<main><div class=sidebar>{art}</div><div class=related>more</div></main>") == "T\nOwn text"
    assert text_of(f"<aside><article>Teaser</article></aside><main>{art}</main>") == "T\nOwn text"


def test_html_names_count_as_a_whole():
    parts = {"market-share": 1, "related-work": 1, "no-comments": 1, "has-sidebar": 1, "cookie-recipes": 1, "post-header": 1,
             "share-bar": 0, "comments": 0, "ad": 0, "ad-300x250": 0, "site_nav": 0, "post-comments": 0, "related-posts": 0,
             "cookie-notice": 0, "widget-12": 0}
    for name, stays in parts.items():
        for key in ("class", "id"):
            want = "The text of the article\nPart" if stays else "The text of the article"
            assert text_of(f"<article><p>The text of the article</p><section {key}='{name}'><p>Part</p></section></article>") == want, name
            assert text_of(f"<p>The text of the article</p><div {key}='x {name}'><p>Part</p></div>") == want, name


def test_html_templates_of_a_section_of_a_large_host(spark):
    menu, rare = "<div class=x>Section menu</div>", "<div class=x>Seen by chance</div>"
    rows = [page(i, "http://large.example/", f"<body>{menu * (i < 8)}{rare * (i < 3)}<p>Own text {i}") for i in range(400)]
    rows += rows[:2] * 5  # copies count once
    for r in html.extract_pages(spark.createDataFrame(rows, PAGES).repartition(3)).collect():
        assert r.text == "Seen by chance\n" * (r.page_id < 3) + f"Own text {r.page_id}"


# --- all of them on empty tables ----------------------------------------------------------------

def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).collect() == [], name
