"""Alignment, quality, hard negatives and repeated ids against brute force."""

import collections
import hashlib
import math
import random
import re
import tracemalloc

import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from cairnspark.llm import alignment, hard_negatives, html_mincut, langid, quality, secret_crf, suffix_dedup
from cairnspark.llm.queries import ORACLE_SQL, QUERIES

from test_operators import write


def sql_rows(name, sf, *tables):
    con = duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet/*.parquet'")
    out = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in out.description]
    return sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in out.fetchall()), key=str)


def spark_rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


# repeated ids in byte string removal


PASSAGE = "a passage of ninety-three bytes that stands in several documents, some of which have one id  ."


def test_each_text_of_an_id_is_judged(spark, tmp_path):
    rows = [(1, PASSAGE), (2, "own words here " + PASSAGE), (2, "other text, " + PASSAGE + " tail"), (3, "x " + PASSAGE), (2, "short"), (None, PASSAGE), (2, "other text, " + PASSAGE + " tail")]
    for shift in (0, 1 << 62):  # ids that can be moved up, and ids that cannot
        df = spark.createDataFrame([(None if k is None else k + shift, t) for k, t in rows], "doc_id long, text string")
        got = suffix_dedup.query(spark, write(tmp_path, "documents", df)).collect()
        assert sorted((r.doc_id - shift, r.n_removed) for r in got if r.doc_id is not None) == [(1, 0), (2, 0), *[(2, len(PASSAGE))] * 3, (3, len(PASSAGE) + 1)]
        assert spark_rows(suffix_dedup.query(spark, str(tmp_path))) == sql_rows("op5_bucket_pointer_dedup", tmp_path, "documents")


def test_dedup_sql_on_repeated_and_null_ids(spark, docs, tmp_path):
    other = docs.selectExpr("doc_id % 7 as doc_id", "concat('before ', text, ' behind') as text")
    sf = write(tmp_path, "documents", docs.select("doc_id", "text").where("doc_id is null or doc_id <> 105").unionByName(other.where("length(text) < 1000")))
    assert spark_rows(QUERIES["op5_bucket_pointer_dedup"](spark, sf)) == sql_rows("op5_bucket_pointer_dedup", sf, "documents")


def test_hot_keys_of_ids_with_several_texts(spark):
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(70))
    docs = spark.createDataFrame([(k, "".join(rnd.choice("xyz") for _ in range(60)) + passage + "".join(rnd.choice("uvw") for _ in range(60))) for k in range(80)], "doc_id long, text string").repartition(4)
    shared = suffix_dedup.shared_anchors(docs, 10**4)  # owners 0 to 7 are texts of one document
    out = [{r.doc_id: (r.lo, r.hi) for r in suffix_dedup.repeated_spans(docs, shared, 10**4, *limits, below=3).collect()} for limits in ((64 << 20, 20_000), (500, 3))]
    assert out[0] == out[1] and sorted(out[0]) == list(range(8, 80))


# alignment


@pytest.fixture(scope="module")
def pair():
    byte_path, piece_path = alignment.default_models()
    tok = Tokenizer.from_file(byte_path)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    return tok, sp, alignment.piece_bytes(sp), alignment.byte_of_character()


def plain_alignment(pair, text):
    """n_a, n_b, groups as text, and links by pair of ids, from the libraries' tokens."""
    tok, sp, of_b, code = pair
    if not text:
        return 0, 0, [], collections.Counter()
    a = tok.encode(" " + text, add_special_tokens=False).ids
    b = sp.encode(text)
    a_bytes = [bytes(code[c] for c in tok.id_to_token(i)) for i in a]
    b_bytes = [of_b[i] for i in b]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return 0, 0, [], collections.Counter()
    ends = lambda of: np.cumsum([len(x) for x in of]).tolist()
    ea, eb = ends(a_bytes), ends(b_bytes)
    groups, links, i, j = [], collections.Counter(), 0, 0
    for cut in sorted(set(ea) & set(eb)):
        i2, j2 = ea.index(cut) + 1, eb.index(cut) + 1
        groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
        links.update((a[p], b[q]) for p in range(i, i2) for q in range(j, j2) if max(ea[p] - len(a_bytes[p]), eb[q] - len(b_bytes[q])) < min(ea[p], eb[q]))
        i, j = i2, j2
    return len(a), len(b), groups, links


@pytest.mark.parametrize("frequent", [alignment.FREQUENT_PAIRS, 5, 0])
def test_alignment_query_against_brute_force(spark, pair, docs, tmp_path, monkeypatch, frequent):
    extra = spark.createDataFrame([(200, "ab▁cd"), (201, "  two\n\n\tspaces  "), (202, "ß\u0000é🎉🎉 naïve"), (203, "<|endoftext|> <s> </s>"), (204, "don't re-tokenise 12345 !!!"), (200, "one id, two texts"), (205, "x" * 3000)], "doc_id long, text string")
    rows = docs.select("doc_id", "text", "score").where("doc_id is null or doc_id <> 105").unionByName(extra, allowMissingColumns=True)
    monkeypatch.setattr(alignment.align, "__defaults__", (frequent,))
    got = QUERIES["op11_shared_cut_alignment"](spark, write(tmp_path, "documents", rows)).collect()
    plain = [(r.doc_id, *plain_alignment(pair, r.text)) for r in rows.collect()]
    held = collections.Counter(p for *_, links in plain for p in links)
    high = {}
    for (a, _), n in held.items():
        high[a] = max(n, high.get(a, 0))
    want = []
    for k, n_a, n_b, groups, links in plain:
        best = sum(m for p, m in links.items() if held[p] == high[p[0]])
        want.append((k, n_a, n_b, len(groups), sum(links.values()), best, sum(m * held[p] for p, m in links.items()), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_alignment_of_the_empty_table(spark, empty, tmp_path):
    assert QUERIES["op11_shared_cut_alignment"](spark, write(tmp_path, "documents", empty)).count() == 0


def test_shared_cuts_are_all_common_ends():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 60, 3000):
        for share in (0.02, 0.5, 0.95):
            ends = [np.unique(np.append(np.flatnonzero(rng.random(n) < share) + 1, n)) for _ in range(2)]
            assert alignment.shared_cuts(*ends).tolist() == np.flatnonzero(np.isin(*ends)).tolist()
    assert alignment.shared_cuts(np.arange(1, 9), np.array([8])).tolist() == [7]


# quality


def spark_hash(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed=h % 2**64).intdigest()
        h -= (h >= 2**63) * 2**64
    return h


def plain_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = [spark_hash(w) for w in words]
    return words, [f % quality.BUCKETS for f in h + [spark_hash(a, b) for a, b in zip(h, h[1:], strict=False)]]


def test_quality_query_against_brute_force(spark, docs, tmp_path):
    rng = random.Random(6)
    junk = [(1000 + k, " ".join(rng.choice(["buy|now", "$$$", "click###", "free!!"]) + str(rng.randrange(40)) for _ in range(40))) for k in range(60)]
    good = [(2000 + k, " ".join(rng.choice("tea river stone quiet wizard lazy tall dark walls strong".split()) + rng.choice(["s", "", "ed"]) for _ in range(50))) for k in range(300)]
    again = [(3000, "one two three four five " * 3), (3001, "a b c d e f g h i j\nsame line\nsame line\n \n \nx"), (3002, "one two three four five six one two three four five"), (3002, "ü# |é")]
    rows = docs.select("doc_id", "text", "score", "lang").unionByName(spark.createDataFrame(junk + good + again, "doc_id long, text string"), allowMissingColumns=True)
    labels = [(k, 1) for k, _ in good[:200]] + [(k, 0) for k, _ in junk[:30]] + [(None, 1), (2000, 0), (2001, None), (7, 1)]
    sf = write(tmp_path, "documents", rows)
    write(tmp_path, "labels", spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int"))
    got = QUERIES["op12_likelihood_ratio_quality"](spark, sf).collect()

    trusted = {k for k, q in labels if q == 1 and k is not None}
    held = {k for k in trusted if spark_hash(k) % (quality.HELD_OUT << 20) % quality.HELD_OUT == 0}
    raw, target = collections.Counter(), collections.Counter()
    texts = [(r.doc_id, r.text) for r in rows.collect()]
    for k, t in texts:
        f = plain_features(t)[1]
        raw.update(f)
        target.update(f if k in trusted - held else [])
    n_raw, n_target = sum(raw.values()), sum(target.values())
    share = quality.PRIOR * n_target / n_raw
    weight = {b: round((math.log((target[b] + share) / (n_target + share * quality.BUCKETS)) - math.log((raw[b] + quality.PRIOR) / (n_raw + quality.PRIOR * quality.BUCKETS))) * quality.UNIT) for b in raw}
    want, scores = [], []
    for k, t in texts:
        words, f = plain_features(t)
        windows = collections.defaultdict(list)
        for i in range(len(words) - 4):
            windows[tuple(words[i : i + 5])].append(i)
        repeated = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
        total = sum(weight[x] for x in f)
        scores.append((k, total / max(len(f), 1), bool(f)))
        want.append([k, len(words), len("".join(words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated), failed, total / max(len(f), 1)])
    steps = sorted(math.floor(s / quality.STEP) for k, s, some in scores if k in held and some)
    least = steps[int(len(steps) * quality.LOSS)]
    for w in want:
        w[-1] = not w[6] and math.floor(w[-1] / quality.STEP) >= least
    assert sorted((tuple(r)[:8] for r in got), key=str) == sorted(map(tuple, want), key=str)
    kept = {r.doc_id for r in got if r.kept}
    assert not kept & {k for k, _ in junk} and len(kept & {k for k, _ in good}) >= 295


def test_quality_without_labels_or_rows(spark, docs, empty, tmp_path):
    sf = write(tmp_path, "documents", docs)
    write(tmp_path, "labels", spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = QUERIES["op12_likelihood_ratio_quality"](spark, sf).collect()
    assert len(got) == docs.count() and all(r.kept == (not r.base_failed) for r in got)
    assert QUERIES["op12_likelihood_ratio_quality"](spark, write(tmp_path, "documents", empty)).count() == 0


def test_quality_counts_every_trusted_id(spark):
    labels = spark.range(1_200_000).selectExpr("id doc_id", "1 quality", "0 toxic")
    got = quality.trusted_ids(labels)
    held = got.where("held").count()
    assert got.count() == 1_200_000 and abs(held - 240_000) < 3_000


def test_quality_by_shuffle(spark, docs, tmp_path, monkeypatch):
    rows = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(None, None), (None, "tea " * 9), (3, "tea behind old walls " * 2)], "doc_id long, text string"))
    sf = write(tmp_path, "documents", rows)
    write(tmp_path, "labels", spark.createDataFrame([(k, 1, 0) for k in (*range(0, 30, 2), 3, 3, 999)] + [(None, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int"))
    want = spark_rows(QUERIES["op12_likelihood_ratio_quality"](spark, sf))
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    assert spark_rows(QUERIES["op12_likelihood_ratio_quality"](spark, sf)) == want and len(want) == rows.count()


# memory of the driver


def traced_peak(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_language_model_is_fitted_in_little_memory():
    rng = random.Random(5)
    rows = [(f"l{k % 6}", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ.,-0123456789", k=2000)).encode()) for k in range(60)]
    model, peak = traced_peak(lambda: langid.PpmModel.fit(rows))
    assert peak < 2.5 * (model.costs.nbytes + sum(r.nbytes for r in model.context_rows))


def test_field_is_trained_in_little_memory():
    crf, peak = traced_peak(lambda: secret_crf.trained.__wrapped__(100, 60, 1))
    assert len(crf.weights) > 500 and peak < 5e6


# hard negatives


def test_subset_sum_scores_are_inner_products():
    rng = np.random.default_rng(1)
    for dim, top in ((1, 1), (8, 200), (13, 5000), (64, 150), (3, 1 << 40), (0, 1)):
        a, b = rng.integers(-top, top + 1, (7, dim)), rng.integers(-top, top + 1, (90, dim))
        assert (hard_negatives.AnchorTables(a).scores(hard_negatives.bit_planes(b)) == b @ a.T).all()
    ends = np.array([[np.iinfo(np.int64).min, np.iinfo(np.int64).max, -1]])
    assert (hard_negatives.AnchorTables(ends).scores(hard_negatives.bit_planes(ends)) == ends @ ends.T).all()  # both wrap around


def test_negatives_query_against_sql(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    rows = [(k, [rng.uniform(-0.6, 0.6) for _ in range(11)], rng.choice([0, 1, 2, 9])) for k in range(420)]
    rows += [(k, rows[5][1], 1) for k in range(500, 620)]  # ties, more than a list holds
    rows += [(700, None, 1), (800, [None, *[0.1] * 10], 1), (900, [float("nan"), *[0.1] * 10], 1), (1000, [0.1] * 11, None), (None, [0.1] * 11, 1), (1100, [0.2] * 4, 1), (1101, [0.2] * 4, 1), (1102, [0.21] * 4, 2), (1200, [], 3), (1201, [], 3), (1202, [], 4), (300, rows[300][1], rows[300][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, score string")
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 64)
    sf = write(tmp_path, "embeddings", df.repartition(3))
    got = spark_rows(QUERIES["op13_four_russians_negatives"](spark, sf))
    assert got == sql_rows("op13_four_russians_negatives", sf, "embeddings") and len(got) > 60
    assert QUERIES["op13_four_russians_negatives"](spark, write(tmp_path, "embeddings", df.limit(0))).count() == 0


# main text


P1, P2 = "The first paragraph tells of a river, and of the old stone bridge over it.", "The second one is long enough too, and it ends the story."
BODY, LINES = f"<h1>A heading of some words</h1><p>{P1}</p><p>{P2}</p>", ["A heading of some words", P1, P2]
LINKS = '<ul><li><a href="/">Home</a></li><li><a href="/b">Blog</a></li></ul>'


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<body><nav>x</nav><article class="post-123 post type-post status-publish format-standard hentry category-news tag-politics">{BODY}<ul><li>One item</li><li>Two</li></ul></article><footer>c</footer>', [*LINES, "One item", "Two"]),
        (f'<body><article class="social-issues">{BODY}</article>', LINES),
        (f'<body><article class="promo-free">{BODY}</article>', LINES),
        (f'<body><article><section id="related-work"><p>{P1}</p></section><div class="side-by-side"><p>{P2}</p></div><section class="legal-analysis"><p>{P1}</p></section></article>', [P1, P2, P1]),
        (f'<body>{LINKS}<div>{BODY}<ul><li>Item one of it</li><li>Item two</li></ul><table><tr><td>a cell</td><td>12</td></tr></table><p>Short.</p></div><div class="footer">Copyright 2020</div>', [*LINES, "Item one of it", "Item two", "a cell", "12", "Short."]),
        ("<body><h1>Prices of tea</h1><table><tr><td>Green tea</td><td>12</td></tr><tr><td>Black tea</td><td>9</td></tr></table>", ["Prices of tea", "Green tea", "12", "Black tea", "9"]),
        (f"<body><article>{BODY}</article><section><h2>3 responses</h2><article><p>I do not think so at all, said one.</p></article><article><p>Nor do I, if you ask me about it, really.</p></article></section>", LINES),
        (f"<body><article>{BODY}<div><h3>Reader comments</h3><p>I do not think so at all, said one reader of it.</p></div></article>", LINES),
        (f"<body><main>{BODY}<h3>2 Comments</h3><div><p>I do not think so at all, said one reader of it.</p></div><p>Another one, not wrapped at all, with words.</p></main>", LINES),
        (f'<body><article>{BODY}<div class="related-posts"><a href=x>Other post</a><p>Some teaser text of it that is not so short as one thinks.</p></div><div class="share-buttons">Share this now</div></article>', LINES),
    ],
)
def test_main_text_of_pages_whose_names_mislead(page, want):
    assert html_mincut.main_text(page) == "\n".join(want)


def test_many_headings_above_comments_take_one_pass():
    import time

    began = time.process_time()
    html_mincut.main_text("<main>" + "<h2>3 comments</h2><p>x y z</p>" * 20_000)
    assert time.process_time() - began < 8
