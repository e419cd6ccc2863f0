"""Classifiers and rules: brute force, planted cases, held-out accuracy."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelloom.llm import importance, language_id, quality_rules, queries, toxicity
from labelloom.llm.common import held_out, labelled_sample
from labelloom.shipping import ship_package

DATA = "/root/testdata/sf0.01"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABEL = "doc_id bigint, quality int, toxic int"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


def odd(spark):
    """Nulls, empty texts, repeated rows and columns whose names clash with those inside."""
    rows = [(1, "", "en"), (2, None, None), (3, "one word here", "en"), (3, "one word here", "en"), (None, "no id at all", "de"), (4, "123 456", "en")]
    return spark.createDataFrame([(i, t, g, "s", 0, 1.0, "k") for i, t, g in rows], DOC + ", score double, label string").withColumn("key", F.lit(1)).withColumn("n", F.lit(2))


def test_gumbel_draw_by_brute_force(spark):
    texts = [(n, "the quick brown fox runs far over hills and fields today " * 3 if n % 2 else "#### @@ 12 ## $$ %% 77 && " * 4) for n in range(60)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(40)], LABEL)
    draw, scored = importance.fit_resampling(docs, labels)
    rows = scored.toPandas()
    raw = np.bincount(np.concatenate([importance.buckets_of(t.encode()) for _, t in texts]), minlength=importance.BUCKETS)
    good = np.bincount(np.concatenate([importance.buckets_of(t.encode()) for n, t in texts if n % 2 and n < 40]), minlength=importance.BUCKETS)
    ratio = importance.log_ratio(good.astype(float), raw.astype(float))
    want = {n: draw.span * ratio[importance.buckets_of(t.encode())].mean() for n, t in texts}
    assert all(abs(want[r.doc_id] - r.log_importance) < 1e-9 for r in rows.itertuples())
    kept = {r.doc_id for r in importance.resample_by_importance(docs, labels).where("kept").collect()}
    best = set(rows.sort_values("key", ascending=False).head(len(kept)).doc_id)
    assert kept == best and len([n for n in kept if n % 2]) >= 28


def test_gumbel_noise_draws_by_weight(spark):
    """Of rows of equal weight the noise alone decides; of two weights the heavier is drawn in proportion."""
    df = spark.range(40_000).withColumn("w", F.when(F.col("id") % 2 == 0, np.log(4.0)).otherwise(0.0))
    df = df.withColumn("noise", importance.gumbel(F.lit(2), F.col("id"))).withColumn("key", F.col("w") + F.col("noise"))
    rows = df.toPandas()
    same = rows[rows.id % 2 == 0]
    cut = importance.kth_largest(df.where("id % 2 = 0"), "key", 2000)
    assert set(same[same.key >= cut].id) == set(same.sort_values("noise", ascending=False).head((same.key >= cut).sum()).id) and 2000 <= (same.key >= cut).sum() <= 2002
    assert abs(rows.noise.mean() - 0.5772) < 0.02 and abs(rows.noise.std() - 1.2825) < 0.02
    cut = importance.kth_largest(df, "key", 1000)
    drawn = rows[rows.key >= cut]
    assert 3.4 < (drawn.id % 2 == 0).sum() / (drawn.id % 2 == 1).sum() < 4.6


def test_kth_largest(spark):
    rng = random.Random(3)
    keys = [rng.gauss(0, 5) for _ in range(400)] + [1.25] * 5
    df = spark.createDataFrame([(k,) for k in keys], "key double")
    for k in (1, 7, 200, 405, 900):
        cut = importance.kth_largest(df, "key", k)
        n = sum(x >= cut for x in keys)
        want = sorted(keys, reverse=True)[min(k, len(keys)) - 1]
        assert n >= min(k, len(keys)) and sum(x >= cut and x < want - 1 / 32768 for x in keys) == 0


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_by_brute_force():
    rng = random.Random(5)
    terms = ["".join(rng.choices("abc", k=rng.randint(5, 7))) for _ in range(25)]
    trie = toxicity.Trie(terms, [])
    for _ in range(3000):
        word = "".join(rng.choices("abc", k=rng.randint(3, 9)))
        assert bool(trie.within_one_edit(word)) == any(_distance(word, t) <= 1 for t in terms), word


def test_stems_with_one_edit_by_brute_force():
    rng = random.Random(6)
    stems = ["".join(rng.choices("abcd", k=rng.randint(4, 6))) for _ in range(4)]
    trie = toxicity.Trie(["dddddddd"], stems)
    for _ in range(5000):
        word = "".join(rng.choices("abcd", k=rng.randint(3, 9)))
        near = len(word) >= 5 and any(len(s) >= 5 and _distance(word[:n], s) <= 1 for s in stems for n in range(len(word) + 1))
        want = toxicity.STEM if any(word.startswith(s) for s in stems) else toxicity.NEAR_STEM if near else toxicity.NONE
        assert trie.match(word) == want or (_distance(word, "dddddddd") <= 1), word


def _match(word, words, stems, clean):
    if any(word.startswith(s) for s in stems):
        return toxicity.STEM
    if word in words:
        return toxicity.EXACT
    if word in clean:
        return toxicity.NONE
    if any(len(w) >= 5 and _distance(word, w) <= 1 for w in words):
        return toxicity.FUZZY
    near = len(word) >= 5 and any(len(s) >= 5 and _distance(word[:n], s) <= 1 for s in stems for n in range(min(len(word), 8) + 1))
    return toxicity.NEAR_STEM if near else toxicity.NONE


def _features(text, words, stems, clean, context):
    tokens = re.findall(r"\S+", text)
    kinds = [_match(toxicity.normal(t), words, stems, clean) for t in tokens]
    around = [max(-3.0, min(3.0, sum(context.get(f, 0.0) for f in toxicity.window_features(tokens, i)))) for i, k in enumerate(kinds) if k]
    n = [kinds.count(k) for k in range(5)]
    return [
        np.log1p(n[toxicity.EXACT]), np.log1p(n[toxicity.FUZZY]), np.log1p(n[toxicity.STEM]), np.log1p(n[toxicity.NEAR_STEM]), float(n[toxicity.EXACT] + n[toxicity.STEM] > 0),
        np.mean(around) if around else 0.0, max(around, default=0.0), np.log1p(100 * len(around) / (len(tokens) + 20)),
    ]


def test_toxicity_scores_by_brute_force(spark):
    """Every score again from plain string distances and counts; only the lexicon and Newton's steps are shared."""
    rng = random.Random(8)
    plain, bad = [f"w{c}{d}ord{e}" for c in "abcdef" for d in "xyz" for e in "kl"], ["vilestuff", "grimbly", "hatebad", "hategood"]
    rows = []
    for n in range(160):
        words = rng.choices(plain, k=25)
        if n % 3 == 0:
            at = rng.randrange(25)
            words[at] = rng.choice(bad)
            words[(at + 7) % 25] = rng.choice(["vilestuf", "grymbly", "hxtebad9", "vilestuff."])
        elif n % 7 == 0:
            words[3] = rng.choice(["grimblys", "worda"])
        rows.append((n, " ".join(words) if n % 40 else ""))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(n, 1, int(n % 3 == 0)) for n in range(130)], LABEL)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels, ~held_out()).collect()}
    learned = [n for n in range(130) if zlib.crc32(str(n).encode()) % 5]
    known = spark.createDataFrame([(n, rows[n][1], int(n % 3 == 0)) for n in learned], "doc_id bigint, text string, label int")
    known = known.withColumn("fold", F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(2)))
    toxic = sum(n % 3 == 0 for n in learned)
    words, stems = toxicity.learn_lexicon(known.select("label", "text"), toxic, len(learned) - toxic)
    assert words or stems
    told = [(r.text, r.label, r.fold) for r in known.collect()]
    near = [{w for t, y, f in told if not y and f in fs for w in map(toxicity.normal, t.split()) if _match(w, words, stems, set()) in (toxicity.FUZZY, toxicity.NEAR_STEM)} for fs in ((1,), (0,), (0, 1))]
    counts = {"quoted": [0, 0], "unquoted": [0, 0]}
    for t, y, _ in told:
        tokens = t.split()
        for i, k in enumerate(_match(toxicity.normal(x), words, stems, near[2]) for x in tokens):
            for f in toxicity.window_features(tokens, i) if k else ():
                counts.setdefault(f, [0, 0])[1 - y] += 1
    counted = {f: c for f, c in counts.items() if sum(c) >= 20 or (f in ("quoted", "unquoted") and sum(c))}
    a, b = (sum(c[i] for c in counted.values()) + 1 for i in (0, 1))
    context = {f: np.log((t + 20 * (t + c) / (a + b)) / (a + 20)) - np.log((c + 20 * (t + c) / (a + b)) / (b + 20)) for f, (t, c) in counted.items()}
    x = np.array([_features(t, words, stems, near[f], context) for t, _, f in told])
    w = toxicity.fit_logistic(x, np.array([float(y) for _, y, _ in told]))
    for n, text in rows:
        z = np.dot(_features(text, words, stems, near[2], context), w[:-1]) + w[-1]
        assert abs(got[n] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-6, n


def test_toxicity_on_held_out_rows(spark):
    got = queries.op3_toxicity(spark, DATA).toPandas()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out, strict=True))
    held = got[got.held_out].merge(labels, on="doc_id")
    assert ((held.predicted == 1) == (held.toxic > 0)).mean() >= 0.9


def test_toxicity_edges(spark):
    one_kind = spark.createDataFrame([(1, 1, 0), (3, 1, 0)], LABEL)
    assert {r.score for r in toxicity.score_toxicity(odd(spark), one_kind, ~held_out()).collect()} == {0.0}
    assert toxicity.score_toxicity(odd(spark).limit(0), one_kind.limit(0), ~held_out()).count() == 0


def test_language_profiles_by_brute_force(spark):
    texts = [(0, "aab abb", "x"), (1, "zzy yyz zzz", "y"), (2, "aab", "x"), (3, "zyzz", "y")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    for length in (5, 300):
        profiles = language_id.learn_profiles(docs, length)
        for lang in ("x", "y"):
            counts: dict[int, int] = {}
            for _, t, g in texts:
                if g == lang:
                    for gram in language_id._grams(language_id._runs(t)).tolist():
                        counts[gram] = counts.get(gram, 0) + 1
            assert profiles[lang].tolist() == [g for g, _ in sorted(counts.items(), key=lambda p: (-p[1], p[0]))[:length]]
    got = language_id.identify_languages(docs, F.lit(True)).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {n: g for n, _, g in texts}


def test_language_on_held_out_rows_and_edges(spark):
    got = queries.op7_language_id(spark, DATA).toPandas().merge(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang_pred == held.lang).mean() >= 0.9 and got.score.between(0, 1).all()
    told = [(r.doc_id, r.lang_pred) for r in language_id.identify_languages(odd(spark), F.lit(True)).collect()]
    assert len(told) == 6 and {p for i, p in told if i in (1, 2, 4)} == {"und"}
    assert language_id.identify_languages(odd(spark).limit(0), F.lit(True)).count() == 0


def _rules(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@pytest.mark.parametrize("text", ["", None, "a b c a b c", "é　ö \x1cx\ny\n\ny\n y", "# | <a> $5\r\n# | <a> $5\r\n", "x " * 40, "ab\x0bcd\x0c\t😀 😀"])
def test_rule_statistics(text):
    assert quality_rules.statistics_of((text or "").encode())[:5] == _rules(text)


def test_rules_of_every_document(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op8_quality_rules(spark, "/root/testdata/sf0.001").collect():
        want = _rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_isolation_forest_finds_the_odd_row():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 0.01, (200, 2)), [[5, 5]]])
    forest = quality_rules.grow_forest(x, 50, 128, 3)
    score = quality_rules.anomaly_scores(x, forest, 128)
    assert score.argmax() == 200 and score[200] > score[:200].max()
    cut = quality_rules.calibrated(score, np.arange(201) == 200, 10.0)
    assert score[:200].max() < cut <= score[200] and quality_rules.calibrated(score, np.zeros(201, bool), 10.0) is None


def test_quality_verdicts_by_brute_force(spark):
    """Anomalies from paths walked node by node, and the cut by trying each score."""
    data = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.judge_quality(docs, labels, trees=20, sample=32).toPandas().set_index("doc_id")
    rest = got[~got.base_failed]
    limits = quality_rules.LIMITS
    over = lambda a, b: np.divide(a, b, out=np.zeros(len(rest)), where=b.to_numpy() > 0)
    n = rest.n_words.astype(float)
    length = over(rest.word_chars, n)
    x = np.column_stack([
        *(np.maximum(over(a, b) - limits[k], 0) for k, a, b in (
            ("symbol_rate", rest.n_symbols, n), ("dup_line_rate", rest.n_dup_lines, rest.n_lines), ("repeat_rate", rest.n_repeat_words, n),
            ("upper_rate", rest.n_upper, rest.n_letters), ("mark_rate", rest.n_marks, n))),
        np.maximum(np.maximum(length - 10, 3 - length), 0),
    ])
    assert np.allclose(x, rest[list(quality_rules.RATES)].to_numpy(float))
    assert len(rest) <= 20 * 32  # all rows are in the draw
    drawn = quality_rules.hash_sample(spark.createDataFrame(rest.reset_index()), 20 * 32, "doc_id", *quality_rules.STATS, seed=8).select(*quality_rules.RATES).toPandas()
    forest = quality_rules.grow_forest(drawn.to_numpy(float), 20, 32, 8)

    def path(tree, row):
        feature, cut, left, right, length = tree
        at = 0
        while feature[at] >= 0:
            at = (left if row[feature[at]] <= cut[at] else right)[at]
        return length[at]

    want = np.array([2.0 ** (-np.mean([path(t, row) for t in forest]) / quality_rules.expected_path(32)) for row in x])
    assert np.allclose(want, rest.anomaly)
    known = labels.toPandas().dropna().groupby("doc_id").quality.max().reindex(rest.index).dropna()
    score, bad = pd.Series(want, rest.index)[known.index].to_numpy(), known.to_numpy() == 0
    gain = {c: (score[bad] >= c).mean() - 10 * (score[~bad] >= c).mean() for c in set(score)}
    best = max(gain.values())
    assert best > 0
    kept = ~(want >= max(c for c, g in gain.items() if g == best) - 1e-9)
    assert (kept == rest.kept).all() and not got[got.base_failed].kept.any()


def test_forest_grows_over_all_rows(spark):
    """Trees grown by hand over every row, more of them than samples of 256 hold; paths walked down the tree."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.judge_quality(docs, labels, trees=3, height=5).toPandas()
    rest = got[~got.base_failed]
    assert len(rest) > 3 * 256
    x = rest[list(quality_rules.RATES)].to_numpy(float)
    paths = np.zeros((3, len(x)))

    def grow(tree, node, part, depth):
        low, high = x[part].min(axis=0), x[part].max(axis=0)
        spread = np.flatnonzero(high > low)
        if depth == 5 or not len(spread):
            paths[tree, part] = depth + quality_rules.expected_path(len(part))
            return
        rng = np.random.default_rng((8, tree, node))
        f = int(rng.choice(spread))
        c = rng.uniform(low[f], high[f])
        grow(tree, 2 * node + 1, part[x[part, f] <= c], depth + 1)
        grow(tree, 2 * node + 2, part[x[part, f] > c], depth + 1)

    for tree in range(3):
        grow(tree, 0, np.arange(len(x)), 0)
    assert np.allclose(2.0 ** (-paths.mean(axis=0) / quality_rules.expected_path(len(x))), rest.anomaly)
    again = quality_rules.judge_quality(docs.repartition(7), labels, trees=3, height=5).toPandas()
    assert again.sort_values("doc_id")[["doc_id", "anomaly", "kept"]].values.tolist() == got.sort_values("doc_id")[["doc_id", "anomaly", "kept"]].values.tolist()


def test_threshold_is_of_all_labelled_rows(spark):
    """Of 40,000 labels those past the 20,000 of smallest hash are the only ones that have documents."""
    labels = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    inside = {r.doc_id for r in labelled_sample(labels, "quality", 20_000).collect()}
    ids = [n for n in range(40_000) if n not in inside][:60]
    bad = set(ids[::10])
    labels = labels.withColumn("quality", F.when(F.col("doc_id").isin(list(bad)), 0).otherwise(1))
    clean = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(n, clean + " #" * 9 * (n in bad) + " $%" * n * (n in bad)) for n in ids], "doc_id bigint, text string")
    got = quality_rules.judge_quality(docs, labels, trees=20).toPandas()
    got = got[~got.base_failed]
    assert bad & set(got.doc_id) and set(got[~got.kept].doc_id) == bad & set(got.doc_id)


@pytest.mark.parametrize("bins", [1, 7, 1 << 16])
def test_threshold_over_a_table(spark, bins):
    rng = np.random.default_rng(bins)
    bad = rng.random(3000) < 0.1
    score = np.round(np.where(bad, rng.normal(0.7, 0.1, 3000), rng.normal(0.4, 0.1, 3000)).clip(0, 1), 3)
    kinds = [("both", np.ones(3000, bool)), ("good", ~bad), ("bad", bad), ("none", np.zeros(3000, bool))]
    for name, held in kinds:
        rows = [(float(s), int(not b), int(b)) for s, b in zip(score[held], bad[held], strict=True)]
        got = quality_rules.calibrated_over(spark.createDataFrame(rows, "anomaly double, good long, bad long"), 10.0, bins)
        want = quality_rules.calibrated(score[held], bad[held], 10.0)
        assert got == want and (got is None) == (name != "both"), name
    turned = spark.createDataFrame([(0.9, 5, 0), (0.1, 0, 5)], "anomaly double, good long, bad long")
    assert quality_rules.calibrated_over(turned, 10.0, bins) is None


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, 0)], LABEL)
    assert quality_rules.judge_quality(odd(spark), labels).where("kept").count() == 0
    assert quality_rules.judge_quality(odd(spark).limit(0), labels.limit(0)).count() == 0
    assert importance.resample_by_importance(odd(spark), labels).count() == 6
    assert importance.resample_by_importance(odd(spark).limit(0), labels.limit(0)).count() == 0


def test_importance_separates_labelled_rows(spark):
    got = queries.op2_importance(spark, DATA).toPandas()
    labels = pd.read_parquet(f"{DATA}/labels.parquet")
    kept = got.merge(labels, on="doc_id").groupby("quality").kept.mean()
    assert kept[1] >= 0.9 and kept[1] > kept[0]
