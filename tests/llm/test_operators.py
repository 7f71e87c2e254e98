"""Small cases with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tallyweave.llm import bpe, decontaminate, html_blocks, line_dedup, queries, secrets, substring_dedup, token_store, topk_codes, toxicity

LOWER = {c: c + 32 for c in range(65, 91)}


def frame(spark, rows, schema="doc_id bigint, text string, source string, n bigint, id string"):
    return spark.createDataFrame([(i, t, "s", 1, "x") for i, t in rows], schema)


def test_line_dedup(spark):
    long = "\n".join(f"line number {k}" for k in range(3000))
    rows = [(2, "Shared line here\nonly two\n SHARED LINE HERE \n"), (1, "x\nshared line here\nshared line here"), (3, long), (4, long), (4, long), (5, None), (6, ""), (None, "only two but longer\nshared line here"), (7, "É shared é line\nshort")]
    docs = frame(spark, rows)
    got = {(r["doc_id"], r["text"]): (r["__n_lines"], r["__n_dropped"], r["__kept"]) for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert got[(2, rows[0][1])] == (4, 2, "only two\n")
    assert got[(1, rows[1][1])] == (3, 0, rows[1][1])
    assert got[(3, long)] == (3000, 0, long) and got[(4, long)] == (3000, 3000, "")
    assert got[(5, None)] == (1, 0, "") and got[(6, "")] == (1, 0, "")
    assert got[(None, rows[7][1])] == (2, 1, "only two but longer")
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_runs_compact(spark):
    docs = frame(spark, [(k, f"common line of text\nown line number {k}\nline of pairs {k // 2}") for k in range(40)])
    got = {r["doc_id"]: r["__n_dropped"] for r in line_dedup.drop_repeated_lines(docs, batches=9).collect()}
    assert got == {k: (k > 0) + k % 2 for k in range(40)}


def test_bpe_round_trip(spark):
    path, pattern = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), queries.bpe_pattern()
    encoding = bpe.load(path, pattern)
    texts = ["", None, "Hello  world\n\n  x", "a" * 3000, "mot é 漢字 🙂 " * 20_000, "<|endoftext|>", " \t\n " * 30]
    got = {r["doc_id"]: r for r in bpe.round_trip(frame(spark, enumerate(texts)), path, pattern).collect()}
    for k, t in enumerate(texts):
        ids = encoding.encode_ordinary(t or "")
        assert got[k]["n_tokens"] == len(ids) and got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_token_store(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = [None, "", "a  b\n c", "tab\t x <|endoftext|> y", " lead", "trail ", "x　 y​ z\x1c w"] + [" ".join(rng.choice(["the", "wordy,", "ünder", "\n"]) + str(rng.randrange(99)) for _ in range(rng.randrange(200))) for _ in range(60)]
    rows = [(3 * k, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.store_and_read(frame(spark, rows), path, shard_bytes=500).collect()}
    start = 0
    for k, t in sorted(rows):
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert got[k] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_store.store_and_read(frame(spark, []), path).count() == 0


def test_decontamination(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([30, 13, 12, 1, 40])] + [(9, None), (10, "!!"), (11, None)]
    items.append((12, items[0][1]))
    texts = [None, "", "...", items[0][1].upper() + " tail", " ".join(items[0][1].split()[3:20]) + ", x " + items[2][1], " ".join(items[1][1].split()[:-1])] + [" ".join([word() for _ in range(50)] + items[4][1].split()[:k] + [word() for _ in range(50)]) for k in range(8, 30)]
    docs, bench = frame(spark, enumerate(texts)), spark.createDataFrame(items, "item_id bigint, text string")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    windows = {}
    for k, t in items:
        w = words(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(k))
    for bits in (decontaminate.BITS, 64):  # a full bitmap changes nothing
        monkeypatch.setattr(decontaminate, "BITS", bits)
        got = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench).collect()}
        for k, t in enumerate(texts):
            w = words(t)
            hit, found = set(), set()
            for i in range(len(w)):
                for n in {len(x) for x in windows}:
                    if i + n <= len(w) and (x := windows.get(tuple(w[i : i + n]))):
                        found |= x
                        hit |= set(range(i, i + n))
            r = got[k]
            assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(found))
            assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
        kept = {r["doc_id"] for r in decontaminate.remove_contaminated(docs, bench).collect()}
        assert kept == {k for k, r in got.items() if not r["contaminated"]}
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_secrets(spark):
    key = "a1b2c3d4e5f60718293a4b5c6d7e8f90"
    rows = [(1, f"token = '{key}' x"), (2, f"é API_KEY:{key}"), (3, "password: ab secret=longvalue9Q7z"), (4, "AKIA" + "B7" * 9), (5, None), (6, ""), (7, "token=token:abcdefgh")]
    docs = spark.createDataFrame([(i, t, f"owner{i if i > 2 else 0}") for i, t in rows], "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r for r in secrets.find_secrets(docs).collect()}
    assert got[1]["spans"] == "assign:0:41,hex:9:41,live:9:41" and got[1]["n_live"] == 1
    assert got[2]["spans"].startswith("assign:2:42")
    assert (got[3]["n_assign"], got[4]["n_access"], got[5]["spans"], got[6]["n_hex"], got[7]["n_assign"]) == (1, 1, "", 0, 0)
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def test_secrets_copied_under_one_owner(spark):
    rows = [(k, "api_key = q7Zp2Lm9Xv4Rt8Kw") for k in range(101)] + [(200, "api_key = h3Nd6Bs1Yc5Gf0Jq")]
    got = {r["doc_id"]: r for r in secrets.find_secrets(frame(spark, rows)).collect()}
    assert [(got[k]["n_live"], got[k]["n_example"], got[k]["max_repos"]) for k in (0, 100, 200)] == [(0, 1, 101), (0, 1, 101), (1, 0, 1)]


def test_html():
    tree = html_blocks.train()
    page = '<html><head><title>T</title><script>var a="</p>"</script></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy now, cheap &amp; good.</div><article><h1>A &lt;b&gt;</h1><p>Some\n  <b>bold</b> text&nbsp;here.<br><p>To to.</p><!-- x --><div class="comments"><p>I think so too, very much.</p></div></article><footer>&copy; us</footer>'
    assert html_blocks.main_text(page, tree) == "A <b>\nSome bold text here.\nTo to."
    assert html_blocks.main_text(None, tree) == "" and html_blocks.main_text("<p", tree) in ("", "<p")
    used = {html_blocks.FEATURES[f] for f in tree.feature if f >= 0}
    assert {"link_density", "density_before", "density_after"} <= used and used & {"words", "words_before", "words_after"}
    for seed in (5, 99):  # the pages learnt from, and others
        right = total = 0
        for text, main in html_blocks.labelled_pages(300, seed):
            found = html_blocks.blocks(text)
            right += sum(k == (b.text in main) for b, k in zip(found, tree.predict(html_blocks.features(found)), strict=True))
            total += len(found)
        assert right >= 0.998 * total


LONG = " ".join(f"word{k}" for k in range(20))


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<article><h1>T</h1><p>{LONG}</p><p>last one</p></article><nav><a href=x>Home</a></nav>", f"T\n{LONG}\nlast one"),
        (f"<article><p>{LONG}</p><p>end.</p></article><footer><a href=x>Home</a> <a href=y>b</a></footer>", f"{LONG}\nend."),
        (f"<article><svg/><p>{LONG}</p><button>a<p>after it</p><select><p>more</p><object><p>and more</article>", f"{LONG}\na\nafter it\nmore\nand more"),
        (f"<p>{LONG}<script>if (a < b) '</p>'</script><style>p</style></p><textarea>form</TEXTAREA >", LONG),
        (f'<article class="related-work"><p>{LONG}</p></article>', LONG),
        (f'<div class="notice-of-events article-text"><p>{LONG}</p><p>{LONG} b</p></div>', f"{LONG}\n{LONG} b"),
        (f'<nav><a href=x>a</a></nav><div class="ad">Buy our new shoes now</div><h1>Title</h1><p>{LONG}</p><p>short</p><p>{LONG} c</p><div class="comments"><p>User Bob wrote</p></div><footer>c 2020</footer>', f"Title\n{LONG}\nshort\n{LONG} c"),
        (f"<article><p>{LONG}</p><ul><li><a href=x>A linked item</a></li><li>two</li></ul><p>{LONG}</p></article>", f"{LONG}\nA linked item\ntwo\n{LONG}"),
        ("<p", "<p"), ("", ""), ("<p>one  &amp;\n two</p>", "one & two"), ("<button>" * 3000 + "x", "x"),
    ],
)
def test_html_pages(page, want):
    assert html_blocks.main_text(page, html_blocks.train()) == want


def test_html_table(spark):
    page = f"<article><p>{LONG}</p></article>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (None, "u", "", "x"), (3, "u", f"<article><p>{'long text ' * 200_000}</p></article>", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html_blocks.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["url"] or "", r["n_chars"]) for r in got.collect()) == [(0, "u", 0), (1, "u", len(LONG)), (1, "u", len(LONG)), (2, "", 0), (3, "u", 1_999_999)]
    assert html_blocks.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [64, 20])
def test_top_k(spark, bits):
    rng = random.Random(bits)
    codes = [rng.getrandbits(bits) for _ in range(60)]
    rows = [(k, codes[rng.randrange(60)] ^ (1 << rng.randrange(bits))) for k in range(300)] + [(300 + k, 5) for k in range(40)]
    signed = lambda c: c - (1 << 64) if c >= 1 << 63 else c
    data = spark.createDataFrame([(i, signed(c)) for i, c in rows] + [(None, 1), (999, None)], "id bigint, code bigint")
    got = {}
    for r in topk_codes.top_k(data, data.where("id % 10 = 0"), k=7, bits=bits, block_codes=50, query_block=8).collect():
        got.setdefault(r["query_id"], []).append((r["distance"], r["neighbor_id"], r["rank"]))
    for i, c in rows:
        if i % 10 == 0:
            want = sorted(((c ^ d).bit_count(), j) for j, d in rows if j != i)[:7]
            assert sorted(got[i]) == [(d, j, k + 1) for k, (d, j) in enumerate(want)]
    assert topk_codes.top_k(data.limit(0), data, k=3).count() == 0


def test_repeated_passages(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    short = [word() for _ in range(30)]
    rows = [(k, " ".join([word() for _ in range(80)] + (passage if k < 5 else short if k < 9 else []) + [word() for _ in range(70)])) for k in range(14)]
    rows += [(20, rows[13][1]), (21, None), (22, ""), (None, " ".join(passage))]
    got = {}
    for r in substring_dedup.repeated_passages(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"], r["class_id"]))
    assert set(got) == {0, 1, 2, 3, 4, 13, 20}
    assert all(got[k] == [(80, 140, 0)] for k in range(5)) and got[13] == got[20] == [(0, 150, 13)]
    assert substring_dedup.repeated_passages(frame(spark, [])).count() == 0


def test_repeated_passages_under_a_template(spark):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**6)}"
    template = [word() for _ in range(40)]
    own = [[word() for _ in range(10)] for _ in range(12)]
    rows = [(k, " ".join([word() for _ in range(60)] + template + own[k // 2] + [word() for _ in range(60)])) for k in range(24)]
    got = {r["doc_id"]: (r["start_word"], r["end_word"], r["class_id"]) for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert got == {k: (60, 110, k - k % 2) for k in range(24)}


def test_near_passages_under_a_template(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    template, rows = [word() for _ in range(30)], []
    for k in range(40):
        body = [word() for _ in range(30)] + template + [word() for _ in range(30)]
        for c in range(2):
            text = list(body)
            if c:
                text[14], text[75] = word(), word()
            rows.append((2 * k + c, " ".join([word() for _ in range(60)] + text + [word() for _ in range(60)])))
    assert len({r["doc_id"] for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}) == len(rows)


def test_passages_over_gaps():
    rng = np.random.default_rng(1)
    stray = rng.integers(1, 2**62, 97).astype(np.uint64)
    a, b = np.r_[stray[:41], stray[50:54], stray[54:95]], np.r_[stray[:41], rng.integers(1, 2**62, 11).astype(np.uint64), stray[54:95]]
    assert substring_dedup.passages(a, b, 46, 0.8) == [(0, 86, 0, 93)]
    edited = np.r_[stray[:30], rng.integers(1, 2**62, 5).astype(np.uint64), stray[35:70]]
    noise = rng.integers(1, 2**62, 40).astype(np.uint64)
    assert substring_dedup.passages(np.r_[stray[:70], noise[:8], stray[80:83]], np.r_[edited, noise[20:27], stray[80:83]], 46, 0.8) == [(0, 70, 0, 70)]  # with the stray shingles the stretch has similarity 0.73


def test_passages_after_common_beginnings():
    rng = np.random.default_rng(2)
    fresh = lambda n: rng.integers(1, 2**62, n).astype(np.uint64)
    opening, rest = fresh(8), fresh(38)
    a = np.concatenate([x for _ in range(100) for x in (opening, fresh(3))] + [opening, rest])
    assert (1100, 1146, 20, 66) in substring_dedup.passages(a, np.r_[fresh(20), opening, rest, fresh(20)], 46, 0.8)


def test_toxicity_counterfactual(spark):
    rng = random.Random(7)
    word = lambda: f"n{rng.choice('abcdefgh')}{rng.choice('klmnop')}x"
    rows, labels = [], []
    for k in range(600):
        bad = k % 3 == 0
        words = [word() for _ in range(20)] + (["nastyword"] if bad else []) + (["muslim"] if bad and k % 2 else [])
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    rows += [(900, None), (901, ""), (902, "my muslim neighbour")]
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    plain, fair = (toxicity.train(docs, lab, counterfactual=c) for c in (0.0, 20.0))
    score = {r["doc_id"]: r["score"] for r in toxicity.score(docs, fair).collect()}
    assert all((score[k] >= 0.5) == (k % 3 == 0) for k in range(600)) and score[900] == score[901] < 0.5 and score[902] < 0.5
    change = [abs(m.scores(["muslim"], {})[0] - m.scores([""], {})[0]) for m in (fair, plain)]
    assert change[0] <= change[1] + 0.05
    assert toxicity.reject(docs, fair).count() == 403
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), lab.limit(0))).count() == 0


def test_toxicity_sample_is_whole():
    assert toxicity.SAMPLE_PER_CLASS == 3000
