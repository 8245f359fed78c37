"""Extraction, sketches, mixing, language model, BPE, archives, classifier, token files."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagewright.llm import bottomk, bpe, files, html_density, mixing, ngram_lm, rule_ensemble, token_output, warc
from pagewright.llm.queries import QUERIES, table, vocabulary_path
from pagewright.workspace import Workspace

LONG = "word and other " * 20_000
DOCS = "doc_id long, text string, source string, s string, h int, block int, n_chars long"
ODD = [(1, "One two three four five six seven", "a"), (2, None, "b"), (3, "", None), (4, " \t\n ", "a"), (None, "no id here", None), (5, LONG, "a"), (6, "One two three four five six seven", "a"), (6, "One two three four five six seven", "a"), (9, "😀 Straße <|endoftext|> x y", "b")]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, len(r[1] or "")) for r in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


# ---------------------------------------------------------------------------------------------- extraction


def test_article_of_every_page(spark, sf_dir):
    import html

    for r in QUERIES["op1_composite_text_density"](spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        plain = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", article))
        assert r.text == " ".join(html.unescape(plain).split()) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<b>b</b>c</p><p>d<br>e</p>", "abc d e"), ("<script>var x = '<p>';</script><p>y</p>", "y"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"), ("<!-- <p>no</p> --><p>yes &#x41;&nbsp;&lt;</p>", "yes A <"), ("<p>open <", "open <"), ("<nav>menu</nav><p>text</p><footer>foot</footer>", "text"),
    ],
)
def test_extraction_of_fragments(page, text):
    assert html_density.main_text(page) == text


def test_density_finds_content_without_names():
    story = "<p>" + "A long sentence of the story goes on and on. " * 8 + "</p>"
    links = "".join(f"<li><a href='/{i}'>link number {i}</a></li>" for i in range(20))
    page = f"<html><body><div><ul>{links}</ul></div><div><div><h2>Head</h2>{story}{story}<p>Short.</p></div></div><div class='user-comments'><p>Nice page, thanks a lot for it.</p></div><form><input value=x>Search</form><aside>Side</aside></body></html>"
    text = html_density.main_text(page)
    assert text.startswith("Head A long") and text.endswith("on. Short.") and "link" not in text and "Nice" not in text and "Search" not in text


STORY = "A long sentence of the story goes on and on, and then some more. " * 6


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ('<div style="overflow:hidden">', "</div>"), ('<p title="a hidden gem">', "</p>"), ('<div data-id="comments-enabled">', "</div>"), ('<div class="layout has-sidebar">', "</div>"), ("<form action='/'>", "</form>"),
        ('<div id="page" class="no-sidebar"><div class="main-menu"><a href=x>Menu</a></div>', '<div class="sidebar">About the author</div></div>'), ('<div class=modal-open>stray<div>', "</div></div>"),
        ('<nav><a href=x>Menu</a></nav><div class="wrapper ads-enabled"><article>', "</article></div><div>Something else stands here, unnamed, and isn't short at all.</div>"),
    ],
)
def test_marks_fall_where_the_article_would_go_with_them(before, after):
    text = html_density.main_text(f"<html><body>{before}<p>{STORY}</p><p>{STORY}</p>{after}<footer>foot</footer></body></html>")
    assert text.replace("stray ", "") == " ".join([STORY, STORY]).replace("  ", " ").strip()


def test_marks_hold_where_the_article_stays():
    advert = "Buy this thing now, it is the best of things that there ever was on sale. " * 3
    for furniture in (f"<div class='ad'>{advert}</div>", f"<section id=comments>{advert}</section>", f"<aside>{advert}</aside>", f"<div role=banner>{advert}</div>", f"<div hidden>{advert}</div>", f"<div class='cookie-notice'><p>{advert}</p></div>"):
        assert html_density.main_text(f"<body>{furniture}<div><h1>Title</h1><p>A short story.</p></div>{furniture}</body>") == "Title A short story."
    assert html_density.main_text("<body><nav>menu</nav><footer>foot</footer></body>") == ""


def test_long_pages_take_time_in_proportion():
    import time

    def took(n):
        page = "<i><div>" + "<b>" * n + f"<p>{STORY}</p>" + "</i></u></td>" * n + "<table>" + "<tr><td>x" * n
        began = time.process_time()
        assert STORY.strip() in html_density.main_text(page)
        return time.process_time() - began

    took(1000)
    small, large = took(4000), took(40_000)
    assert large < 40 * small + 1


def test_extract_keeps_rows(spark):
    frame = spark.createDataFrame([(1, None, None, "t"), (None, "u", "<p>x</p>", "t"), (2, "u", "<p>x</p>", "t"), (2, "u", "<p>x</p>", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_density.extract(frame).collect()) == [(0, "x", 1), (1, "", 0), (2, "x", 1), (2, "x", 1)]
    assert html_density.extract(frame.limit(0)).count() == 0


# ---------------------------------------------------------------------------------------------- sketches


def shingles(text):
    w = (text or "").lower()
    w = words(w)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketches_estimate_likeness(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").orderBy("doc_id").collect()]
    found = {r.doc_id: r for r in QUERIES["op4_bottom_k_sketches"](spark, sf_dir).collect()}
    errors = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert found[i].n_chars == len(text) and found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors.append(abs(found[i].near_edited - jaccard(shingles(text), shingles(edited))))
        errors.append(abs(found[i].near_next - jaccard(shingles(text), shingles(after))))
        if len(shingles(text) | shingles(edited)) <= bottomk.K:
            assert errors[-2] < 1e-9
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.03


def test_edited_texts_of_odd_rows(spark):
    found = bottomk.edited_likeness(Workspace(spark, "test"), docs(spark, ODD)).collect()
    assert len(found) == len(ODD)
    texts = {1: "One two three four five six seven", 2: "", 3: "", 4: " \t\n ", 5: LONG, 6: "One two three four five six seven", 9: ODD[-1][1]}
    ids = sorted(texts)
    by = {r.doc_id: r for r in found}
    for k, i in enumerate(ids):
        t, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        assert by[i].edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 4] + after[: len(t) // 4]).encode()).hexdigest()
    assert by[1].fingerprint == by[6].fingerprint and by[2].near_next == 1.0 and by[2].fingerprint == ""
    assert bottomk.edited_likeness(Workspace(spark, "test"), docs(spark, [])).count() == 0
    assert bottomk.edited_likeness(Workspace(spark, "test"), docs(spark, [(4, "alone by itself", "a")])).first().near_next == 1.0


def test_edited_texts_of_unequal_rows_with_one_id(spark):
    texts = ["short one here", "a much longer text of the same document " * 20, None]
    after = "the next document lends its beginning " * 30
    for last in (1, 3):  # as the one before, and as the last whose next is the first
        found = bottomk.edited_likeness(Workspace(spark, "test"), docs(spark, [(last, t, "a") for t in texts] + [(2, after, "a")])).collect()
        told = sorted(hashlib.sha256((t[: len(t) - len(t) // 4] + after[: len(t) // 4]).encode()).hexdigest() for t in map(lambda x: x or "", texts))
        assert sorted(r.edited_sha256 for r in found if r.doc_id == last) == told


def test_merging_nothing(spark):
    rows = spark.createDataFrame([("a", None), ("a", []), ("b", None), (None, [3, 1]), (None, [3, 1]), ("c", [5, 7])], "k string, sketch array<long>")
    assert {r.k: r.sketch for r in bottomk.merge_all(rows, ["k"], "sketch").collect()} == {"a": [], "b": [], None: [1, 3], "c": [5, 7]}
    assert bottomk.merge_all(rows.limit(0), ["k"], "sketch").count() == 0


def test_sketches_merge(spark):
    text = " ".join(f"w{i}" for i in range(2000))
    other = " ".join(f"w{i}" for i in range(1000, 3000))
    rows = spark.createDataFrame([("a", text), ("b", other)], "k string, text string").select("k", bottomk.sketch(F.col("text")).alias("sketch"))
    one, two = (rows.where(F.col("k") == k).select(F.col("sketch").alias(k)) for k in "ab")
    r = one.crossJoin(two).select(bottomk.resemblance(F.col("a"), F.col("b")).alias("r"), bottomk.containment(F.col("a"), F.col("b")).alias("c"), bottomk.distinct_shingles(F.col("a")).alias("n"), bottomk.merge(F.col("a"), F.col("b")).alias("m")).first()
    assert abs(r.r - 1 / 3) < 0.15 and abs(r.c - 0.5) < 0.2 and abs(r.n - 1996) < 600
    assert bottomk.merge_all(rows.withColumn("g", F.lit(1)), ["g"], "sketch").first()["sketch"] == r.m


# ---------------------------------------------------------------------------------------------- mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, live, out = float(sum(sizes.values())), set(order), {}
    while live:
        share = left / sum(w[s] for s in live)
        over = [s for s in live if share * w[s] > 3 * sizes[s]]
        if not over:
            return out | {s: share * w[s] for s in live}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            live.discard(s)
    return out


def check_mix(rows, found):
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    target = brute_targets(size)
    assert len(found) == len(rows)
    by_source = {i: s for i, _, s in rows}
    taken = Counter()
    for r in found:
        s = by_source[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= max(48, 0.02 * target[s]), s


def test_mix_of_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.source) for r in table(spark, sf_dir, "documents").collect()]
    found = QUERIES["op5_mixing_by_blocks"](spark, sf_dir).collect()
    check_mix(rows, found)
    assert sorted(found) == sorted(QUERIES["op5_mixing_by_blocks"](spark, sf_dir).collect())


def test_mix_of_odd_rows_and_its_texts(spark):
    rng = random.Random(2)
    rows = ODD[:-3] + [(100 + i, " ".join(f"d{i}w{j}" for j in range(rng.randint(0, 90))), rng.choice(["a", "b", "c", None, "é"])) for i in range(150)]
    rows = [(i, t, s) if i is not None else (999, t, s) for i, t, s in rows]
    frame = docs(spark, rows)
    mix = mixing.Mix(Workspace(spark, "test"), frame)
    found = mix.taken().collect()
    check_mix(rows, found)
    texts = mix.texts(frame)
    assert texts.columns == frame.columns
    got = Counter()
    for r in texts.collect():
        got[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert {r.doc_id: r.taken for r in found if r.taken} == dict(got)
    slots = mix.slots().collect()
    for shard in {r.shard for r in slots}:
        own = [r for r in slots if r.shard == shard]
        assert sorted(r.position for r in own) == list(range(len(own)))
    assert Counter((r.shard, r.s) for r in slots) == {(r.shard, r.s): r.n for r in mix.counts().collect()}
    assert len({(r.s, r["pass"], r.block) for r in slots}) == len(slots)
    with_null = mixing.Mix(Workspace(spark, "test"), docs(spark, ODD)).taken()
    assert with_null.count() == len(ODD)
    assert mixing.Mix(Workspace(spark, "test"), docs(spark, [])).taken().count() == 0
    assert mixing.Mix(Workspace(spark, "test"), docs(spark, [(1, "", "a"), (2, None, None)])).taken().agg(F.sum("taken")).first()[0] == 0


def test_shards_draw_from_a_multinomial(spark):
    """Counts by shard scatter as independent draws do; what is taken of a source is what the shards have drawn."""
    rows = [(i, f"a{i} " * 400, "a" if i % 2 else "b") for i in range(1600)]
    mix = mixing.Mix(Workspace(spark, "test"), docs(spark, rows), shard_slots=500)
    sources = {r.s: r for r in mix.sources.collect()}
    total, share = mix.total, sources[0].asked / mix.total
    drawn = [r.n for r in mix.draws.where("s = 0").collect()]
    assert len(drawn) == -(-total // 500) and sum(r.n for r in mix.draws.collect()) == total
    spread = np.var(drawn[:-1]) / (500 * share * (1 - share))
    assert 0.3 < spread < 2.5
    assert any(r.drawn != r.asked for r in sources.values())
    for r in sources.values():
        assert r.slots == min(max(r.drawn, r.asked - math.floor(r.asked * mixing.TOLERANCE)), r.asked + math.floor(r.asked * mixing.TOLERANCE), 3 * r.n_blocks)
    by_source = Counter()
    for r in mix.taken().collect():
        by_source[r.doc_id % 2] += r.taken
    assert sorted(by_source.values()) == sorted(r.slots * mixing.BLOCK_WORDS for r in sources.values())


def test_repeated_rows_and_clashing_columns_in_the_mix(spark):
    """Rows that agree in all columns are copies: each is a document; columns may be named like the plan's own."""
    rows = [(7, "one two three " * 30, "a", "h1", 1)] * 3 + [(7, "one two three " * 30, "a", "h2", None), (None, "x y", "a", None, 2), (0, "x y", "a", None, 2), (8, None, None, "q", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, before string, pass int")
    mix = mixing.Mix(Workspace(spark, "test"), frame)
    found, texts = mix.taken().collect(), mix.texts(frame)
    assert len(found) == len(rows) and texts.columns == frame.columns
    assert sum(r.taken for r in found) == sum(len(words(r.text)) for r in texts.collect())
    assert mix.texts(frame).where("before = 'h2'").count() >= 1


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 17, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permute(F.col("id"), F.lit(n).cast("long"), F.lit("k"))).collect()]
        assert sorted(got) == list(range(n))


# ---------------------------------------------------------------------------------------------- language model


def brute_model(rows, weights):
    """Scores by plain dictionaries, with the learned weights."""
    fold = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 10
    seqs = [[w.encode().lower() for w in words(t)] + [None] for _, t, *_ in rows]
    uni, bi, starts = Counter(), Counter(), 0
    for (i, *_), s in zip(rows, seqs, strict=True):
        if fold(i):
            starts += 1
            uni.update(s)
            bi.update(zip(["<s>", *s], s, strict=False))
    n, v = sum(uni.values()), len(uni)
    out = []
    for (i, *_), s in zip(rows, seqs, strict=True):
        total = 0.0
        for h, w in zip(["<s>", *s], s, strict=False):
            c = starts if h == "<s>" else uni[h]
            k = weights[min(ngram_lm.BUCKETS - 1, math.ceil(math.log2(c + 1)))]
            total += math.log10(k[0] * bi[h, w] / max(c, 1) + k[1] * uni[w] / max(n, 1) + k[2] / (v + 1))
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s)
        out.append((i, not fold(i), len(s), sum(uni[w] > 0 for w in s), n, base, total))
    return out


def same_scores(found, brute):
    key = lambda r: (r[0] is None, r[0] or 0)
    for a, b in zip(sorted((tuple(r) for r in found), key=key), sorted(brute, key=key), strict=True):
        assert a[:5] == b[:5]
        assert abs(a[5] - b[5]) <= 1e-9 * max(1, abs(b[5])) and abs(a[6] - b[6]) <= 1e-9 * max(1, abs(b[6]))


def test_model_of_the_table(spark, sf_dir):
    frame = table(spark, sf_dir, "documents")
    model = ngram_lm.Model(Workspace(spark, "test"), frame)
    found = model.scores().collect()
    same_scores(found, brute_model([(r.doc_id, r.text) for r in frame.collect()], model.weights))
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert np.allclose(model.weights.sum(axis=1), 1) and model.weights[0, 0] == 0


def test_model_of_odd_rows(spark):
    model = ngram_lm.Model(Workspace(spark, "test"), docs(spark, ODD))
    same_scores(model.scores().collect(), brute_model(ODD, model.weights))
    assert ngram_lm.Model(Workspace(spark, "test"), docs(spark, [])).scores().count() == 0


def test_model_of_a_table_that_is_cut_otherwise_when_read_again(spark, sf_dir):
    """Blocks are the same documents however many tasks read the table, so counts and texts always belong together."""
    whole = QUERIES["op6_deleted_interpolation"](spark, sf_dir).collect()
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions")}
    frame = table(spark, sf_dir, "documents")
    try:
        old, ngram_lm.BLOCK_BYTES = ngram_lm.BLOCK_BYTES, 64 << 10
        model = ngram_lm.Model(Workspace(spark, "test"), frame)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        again = model.scores().collect()
    finally:
        ngram_lm.BLOCK_BYTES = old
        for k, v in before.items():
            spark.conf.set(k, v)
    same_scores(again, [tuple(r) for r in whole])


def test_counts_beyond_32_bits():
    import pyarrow as pa

    keys, counts = np.array([5, 9], "<u8").tobytes(), np.array([3_000_000_000, 7], "<u4").tobytes()
    told = ngram_lm._sum(pa.Table.from_batches([ngram_lm._batch([(0, 0, 1, 0, keys, counts), (1, 1, 1, 0, keys, counts)], ngram_lm.REQUEST)])).to_pylist()
    assert told[0]["n"] == 6_000_000_014 and told[0]["n_part"] == 3_000_000_007 and told[0]["v"] == 2
    assert all(r["width"] == 8 and np.frombuffer(r["total"], "<u8").tolist() == [6_000_000_000, 14] for r in told[1:])


def test_weights_come_from_evidence():
    bucket, n = np.array([3, 3]), np.array([90.0, 10.0])
    w = ngram_lm.learn_weights(bucket, np.array([0.5, 0.0]), np.array([0.01, 0.01]), 1e-6, n)
    assert w[3, 0] > 0.8 and abs(w[3].sum() - 1) < 1e-9


# ---------------------------------------------------------------------------------------------- BPE and token files


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("by", ["pair index", "library"])
def test_words_are_those_of_the_library(library, plain, by):
    rng = random.Random(1)
    pool = ["a", "s", "t", "re", "ve", "ll", "'", "'", " ", " ", "\n", "\t", "1", "9", "!", "é", "Ü", "S", "d", "m", "_"] if plain else [*" \n\t", "  ", "\x85", "\xa0", "\x1c", "a", "B", "é", "ß", "²", "½", "٣", "漢字", "!", "…", "😀", "<|endoftext|>", "<|", "'s", "'ll", "'T", "_", "\0", "º", "µ", "×", "aaaa", "abab", "the ", "ing", "﻿"]
    texts = ["", *("".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(3000)), "a" * 5000, " " * 999]
    enc = bpe.Encoder(bpe.Vocabulary(vocabulary_path())) if by == "pair index" else token_output.library_encoder(vocabulary_path())
    ids, count = enc.batch(texts)
    at = 0
    for text, n, e in zip(texts, count, library.encode_batch(texts, add_special_tokens=False), strict=True):
        own, at = ids[at : at + n], at + n
        assert own.tolist() == e.ids, text
        assert enc.vocabulary.decode(own.astype(np.int64)) == library.decode(e.ids, skip_special_tokens=False)


def test_words_are_forgotten_in_bounds(library):
    enc = bpe.Encoder(bpe.Vocabulary(vocabulary_path()), remember=5)
    for text in ("one two three four five six", "seven eight one", "<|endoftext|> nine", "ten <|endoftext|>"):
        assert enc.batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip_of_odd_rows(spark, library):
    frame = docs(spark, ODD)
    found = bpe.round_trip(frame, vocabulary_path()).collect()
    expected = []
    for i, t, _ in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    tokens = bpe.encode(frame, vocabulary_path())
    back = {r.doc_id: r.text for r in bpe.decode(tokens, vocabulary_path()).collect()}
    assert back == {i: t or "" for i, t, _ in ODD}
    assert bpe.round_trip(docs(spark, []), vocabulary_path()).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, library, encoding):
    import pyarrow.parquet as pq

    frame = docs(spark, ODD)
    ws = Workspace(spark, "test")
    manifest = token_output.write_tokens(ws, frame, vocabulary_path(), 3, encoding, group_ids=20_000)
    found = token_output.read_tokens(spark, manifest)
    rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in token_output.checksums(found).collect()), key=lambda r: r[1])
    start, expected = 0, []
    for i, t, _ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        expected.append((i if i is not None else -1, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows == expected
    assert found.where("doc_id = 5").select("n_tokens").first()[0] == expected[[e[0] for e in expected].index(5)][2]
    name = max(manifest.collect(), key=lambda r: r.n_tokens).path
    with files.Whole(name) as out:  # what a lost executor leaves: a file that never got its name
        fs, path = files.filesystem(name)
        out.write(fs.open_input_file(path).read()[:100])
        out.flush()
        folder = name.rpartition("/")[0]
        assert token_output.checksums(found).count() == spark.read.parquet(folder).count() == len(ODD)
        out.write(fs.open_input_file(path).read()[100:])
    assert token_output.checksums(found).count() == len(ODD)
    seen = found.where("doc_id = 5").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,5)" in seen and "ids" not in seen.partition("ReadSchema:")[2].partition("\n")[0]
    fs, path = files.filesystem(name)
    meta = pq.read_metadata(path, filesystem=fs)
    column = meta.row_group(0).column(3)
    assert column.has_offset_index and column.has_column_index
    assert ("RLE_DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY_PACKED") in column.encodings
    empty = token_output.write_tokens(ws, docs(spark, []), vocabulary_path())
    assert token_output.checksums(token_output.read_tokens(spark, empty)).count() == 0


def test_token_order_over_parts(spark, sf_dir, library):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").orderBy("doc_id").collect()]
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_output.checksums(token_output.read_tokens(spark, token_output.write_tokens(Workspace(spark, "test"), table(spark, sf_dir, "documents"), vocabulary_path(), 5))).collect()}
    start = 0
    for (i, _), e in zip(rows, library.encode_batch([t for _, t in rows], add_special_tokens=False), strict=True):
        assert found[i] == (start, len(e.ids) + 1, zlib.crc32(np.array([*e.ids, 0], "<u4").tobytes()))
        start += len(e.ids) + 1


# ---------------------------------------------------------------------------------------------- archives


def test_archives_round_trip(spark):
    import zstandard

    rows = [(1, "http://a/ b", "<p>x</p>"), (2, None, None), (3, "u", "<p>x</p>"), (4, "u", ""), (5, "u", "é" * 3000), (5, "u", "é" * 3000), (None, "u", "<p>x</p>"), (6, "u", "y" * 300_000), (7, "u", "\r\n\r\nWARC/1.1\r\n")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, sha1 string").repartition(2)
    index = warc.write_archives(Workspace(spark, "test"), frame, frame_bytes=4096)
    found = warc.read_records(index).collect()
    assert len(found) == len(rows)
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    expected = []
    for i, _, h in rows:
        p = (h or "").encode()
        revisit = i is not None and last[h or ""] != i
        expected.append((i or 0, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", last[h or ""] if revisit else None))
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == sorted(expected)
    payloads = {r.page_id: bytes(r.payload) for r in found if r.record_type == "response"}
    assert payloads[5] == ("é" * 3000).encode() and payloads[7] == b"\r\n\r\nWARC/1.1\r\n" and payloads[4] == b""
    assert [r.page_id for r in warc.read_pages(spark, index, [6]).collect()] == [6]
    for (name,) in index.select("archive").distinct().collect():  # any tool reads the archive from front to back
        fs, path = files.filesystem(name)
        data = fs.open_input_file(path).read()
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert whole.count(b"WARC-Type:") == index.where(F.col("archive") == name).count()
    assert warc.read_records(warc.write_archives(Workspace(spark, "test"), frame.limit(0))).count() == 0
    assert warc.read_records(index, run=100_000).rdd.getNumPartitions() > 2  # runs are dealt out by number
    name = next(r.archive for r in index.where("page_id = 6").collect())
    fs, path = files.filesystem(name)
    row = index.where("page_id = 6").first()
    with files.Whole(name) as out:  # the same places, another payload
        writer = warc.Writer(out, 1 << 20)
        for r in sorted(index.where(F.col("archive") == name).collect(), key=lambda r: (r.frame, r.offset)):
            writer.frame_bytes = 0 if r.offset == 0 else 1 << 20
            writer.add(warc.record(r.page_id, "u", b"z" * 300_000, "A" * 32, None, False)[: r.length])
        writer.close()
    with pytest.raises(Exception, match="what its record says|no WARC record"):
        warc.read_records(index.where("page_id = 6")).collect()
    assert row.length > 300_000


def test_archives_of_the_table(spark, sf_dir):
    rows = {r.page_id: (r.html or "").encode() for r in table(spark, sf_dir, "pages").collect()}
    last = {}
    for i, p in rows.items():
        last[p] = max(i, last.get(p, i))
    expected = {(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if last[p] == i else "revisit", None if last[p] == i else last[p]) for i, p in rows.items()}
    assert {tuple(r) for r in QUERIES["op8_seekable_warc"](spark, sf_dir).collect()} == expected


# ---------------------------------------------------------------------------------------------- classifier


def test_classifier_on_held_out_labels(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    found = QUERIES["op9_rule_ensemble"](spark, big).join(table(spark, big, "labels"), "doc_id").where("held_out").collect()
    assert len(found) > 50
    assert sum(r.predicted == r.quality for r in found) / len(found) > 0.93
    good = [r for r in found if r.quality == 1]
    assert sum(r.predicted for r in good) / len(good) > 0.97
    for r in found:
        assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_scores_are_those_of_plain_rules(spark, sf_dir):
    """Statistics and scores of whole texts against a plain version."""
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()] + [(i, t) for i, t, _ in ODD if i not in (5,)]
    model = rule_ensemble.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    found = [(r.doc_id, r.score) for r in rule_ensemble.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()]

    def plain(text):
        t = text or ""
        w, n = words(t), max(1, len(t))
        share = lambda pattern: 1 - len(regex.sub(pattern, "", t)) / n
        twice = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+(?=\1(?![^\x20\x09-\x0D]))"
        values = [len(w), len(t) / max(1, len(w)), len(set(w)) / max(1, len(w)), share(twice), share(r"\p{Lu}+"), share("[0-9]+"), share("[!?]+"), share(r"[%$#&*@^~<>={}\\\[\]+_]+"), share(r"\|+"), share("[.,;:]+"), share(r"\n+")]
        x = dict(zip(model.names, values, strict=True))
        z = model.intercept + sum(weight for rule, weight in model.rules if all((x[k] > t) == above for k, above, t in rule.terms))
        return 1 / (1 + math.exp(-z))

    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for a, b in zip(sorted(found, key=key), sorted(((i, plain(t)) for i, t in rows), key=key), strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-9


def test_rules_compile_to_what_they_match(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, 2))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(float)
    rules = rule_ensemble.extract_rules(x, y, ["u", "v"], 10)
    r = np.stack([rule.matches(x, ["u", "v"]) for rule in rules], axis=1).astype(float)
    b, w = rule_ensemble.lasso_logistic(r, y, 1e-3)
    assert ((b + r @ w > 0) == y).mean() > 0.97 and (np.abs(w) < 1e-9).mean() > 0.3
    model = rule_ensemble.RuleEnsemble(b, tuple(zip(rules, map(float, w), strict=True)), ("u", "v"))
    got = [s for (s,) in spark.createDataFrame(x.tolist(), "u double, v double").select(model.score()).collect()]
    assert np.allclose(sorted(got), sorted(1 / (1 + np.exp(-(b + r @ w)))))


def test_classifier_of_odd_rows(spark):
    frame = docs(spark, ODD)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (77, 0)], "doc_id long, quality int")
    found = rule_ensemble.score(frame, rule_ensemble.fit(frame, labels)).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    model = rule_ensemble.fit(frame, labels.limit(0))
    assert rule_ensemble.keep_good(frame, model).columns == frame.columns
    assert rule_ensemble.score(docs(spark, []), model).count() == 0


# ---------------------------------------------------------------------------------------------- pipeline


def test_pipeline_is_its_stages(spark, sf_dir, library):
    import corpus_pipeline as pipeline

    docs_ = table(spark, sf_dir, "documents")
    good = pipeline.quality(spark, docs_, sf_dir)
    kept = pipeline.near_dedup(spark, good, sf_dir)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    rows = {r.doc_id: shingles(r.text) for r in good.collect()}
    parent = {i: i for i in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in rows:
        for j in rows:
            if j < i and find(i) != find(j) and jaccard(rows[i], rows[j]) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert ids == {find(i) for i in rows}
    mixed = pipeline.mix(spark, kept, sf_dir)
    assert good.columns == kept.columns == mixed.columns == docs_.columns
    expected = Counter()
    for r in mixed.collect():
        ids_ = library.encode(r.text, add_special_tokens=False).ids
        expected[r.doc_id, len(ids_), hashlib.sha256(r.text.encode()).hexdigest()] += 1
    found = Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in pipeline.run(spark, sf_dir).collect())
    assert found == expected and [n for n, _ in pipeline.STAGES] == ["quality", "near_dedup", "mix", "bpe"]
