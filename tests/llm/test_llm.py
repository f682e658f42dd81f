"""Each operator against brute force, the tokenizers' library, round trips or held-out labels; then the defined cases."""

import hashlib
import re
import zlib

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from beliefmesh.llm import fingerprints, langid, mixing, neardup, packing, queries, rules, tokencount, tokens, toxicity, urlfilter, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, rank int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, odd characters, columns that clash with inner names."""
    long_text = " ".join(f"word{i}" for i in range(30000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "it's a plain text. It's here\nand there", "en", "a", 38), (3, "it's a plain text. It's here\nand there", "en", "a", 38),
        (None, "no id here <|endoftext|> x", "fr", None, 26), (5, long_text, "de", "a", len(long_text)), (6, "İstanbul Σς ½ \u0085 ﬁ", "en", "b", 16), (7, "... !!! 123", None, "a", 11), (8, "two words", "es", "b", 9),
    ]
    return spark.createDataFrame([(*r, "s", 1) for r in rows], DOCS)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), oracle.connect(SF).execute(queries.oracle_sql()[name]).df()
    assert oracle.rows(got) == oracle.rows(want)


def test_mix_is_earliest_deadline_first_within_windows(spark):
    d = spark.createDataFrame([(i, "t", s) for i, s in enumerate(["a"] * 300 + ["b"] * 60 + ["c"] * 30 + [None] * 10)], "doc_id long, text string, source string")
    got = mixing.schedule(d, {"a": 0.5, "b": 0.3, "c": 0.15, None: 0.05}, block_rows=4, units=20).toPandas()
    blocks = got.groupby(["source", "block"], dropna=False).agg(slot=("slot", "first"), n=("slot", "nunique"), rel=("release", "first"), due=("deadline", "first"), u=("units", "first")).reset_index()
    assert (blocks.n == 1).all() and blocks.slot.is_unique and len(got) == 400
    assert (blocks.slot >= blocks.rel).all() and (blocks.slot < blocks.due).all()
    units = {"a": 10, "b": 6, "c": 3, "": 1}  # brute force: simulate slot by slot
    done, order = dict.fromkeys(units, 0), []
    keys = sorted(units, key=lambda k: "null" if k == "" else f"s:{k}")
    for t in range(20):
        ready = [(-(-(done[k] + 1) * 20 // units[k]), i, k) for i, k in enumerate(keys) if done[k] < units[k] and done[k] * 20 // units[k] <= t]
        k = min(ready)[2]
        done[k] += 1
        order.append(k)
    seen = blocks.assign(s=blocks.source.fillna("")).set_index("slot").s
    assert all(order[t % 20] == k for t, k in seen.items())
    for t in range(20, 120, 7):  # less than one block from the weight while all sources last
        for k, u in units.items():
            if (seen == k).sum() > t * u / 20 + 1:
                assert abs((seen[seen.index < t] == k).sum() - t * u / 20) < 1


def test_mix_keeps_rows_and_columns(odd, empty):
    assert mixing.mix(odd).columns == odd.columns
    assert sorted(map(str, mixing.mix(odd).collect())) == sorted(map(str, odd.collect()))
    assert mixing.mix(empty).count() == 0


def test_language(docs, odd, empty):
    got = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred != 'und'").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.9
    r = {x["doc_id"]: x for x in langid.identify(odd, langid.fit(docs)).collect()}
    assert r[1]["lang_pred"] == r[2]["lang_pred"] == r[7]["lang_pred"] == "und" and r[1]["score"] == 0 and r[5]["n_windows"] > 100
    assert langid.predict(empty).count() == 0 and langid.accept(odd).columns == odd.columns
    assert langid.identify(odd, None).where("lang_pred != 'und'").count() == 0


def test_training_learns_two_byte_languages():
    rng = np.random.default_rng(0)
    text = lambda letters: bytes(rng.choice(np.frombuffer(letters, np.uint8), 200))
    x, y = [text(b"abc ") for _ in range(60)] + [text(b"xyz ") for _ in range(60)], ["a"] * 60 + ["x"] * 60
    k, p, _ = langid.Network(langid.train(x, y, epochs=60)).score([text(b"abc ") * 3, text(b"xyz ")])
    assert list(k) == [0, 1] and (p > 0.9).all()


def pieces(t):
    return set(re.findall("[^\n]{1,%d}" % fingerprints.PIECE, t))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_fingerprints_equal_brute_force(request, which):
    d = request.getfixturevalue(which)
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in d.collect()), key=lambda r: r[0])
    got = fingerprints.fingerprints(d, slices=7).fillna(-1, ["doc_id"]).toPandas().sort_values("doc_id", kind="stable")
    like = lambda a, b: len(pieces(a) & pieces(b)) / len(pieces(a) | pieces(b)) if pieces(a) | pieces(b) else 1.0
    want = []
    for i, (k, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        want.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(t, e), 9), round(like(t, nxt), 9)))
    assert sorted(want) == sorted((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got.itertuples())
    assert fingerprints.fingerprints(d.where("false")).count() == 0


def test_sketch_peels_to_the_difference(spark):
    q = f"select {fingerprints.peel(fingerprints.subtract(fingerprints.sketch('array(1L, 2L, 3L, 99L)', 8), fingerprints.sketch('array(2L, 3L, 7L)', 8)), 8)} as d"
    assert sorted(spark.sql(q).first()["d"]) == [1, 7, 99]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing(request, which):
    d = request.getfixturevalue(which)
    got = packing.pack(d).toPandas()
    t = tokens.load(tokens.vocabulary_path(packing.VOCABULARY))
    want = []
    for r in d.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k, i in enumerate(range(0, len(ids), 4096)):
            cut = ids[i : i + 4096]
            want.append((r["doc_id"] if r["doc_id"] is not None else -1, k, i, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    got["doc_id"] = got.doc_id.fillna(-1).astype(int)
    assert sorted(want) == sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.concatenate([[0], s.length.cumsum().to_numpy()[:-1]])).all() and s.length.sum() <= 4096
    assert packing.pack(d.where("false")).count() == 0


def test_best_fit_on_counts_places_every_rank_once():
    rng = np.random.default_rng(1)
    for _ in range(20):
        h = {int(k): int(rng.integers(1, 50)) for k in rng.integers(1, 101, 30)}
        used, ranks = {}, {k: set() for k in h}
        for length, a, b, first, offset in packing.plan(h, 100):
            for r in range(a, b):
                ranks[length].add(r)
                used.setdefault(first + r - a, []).append((offset, length))
        assert all(ranks[k] == set(range(n)) for k, n in h.items())
        for s in used.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= 100
        assert len(used) <= 1.25 * -(-sum(k * n for k, n in h.items()) // 100) + 1


@pytest.mark.parametrize("which", ["docs", "odd"])
@pytest.mark.parametrize("frequent", [10, 10000])
def test_token_counts(request, which, frequent):
    d = request.getfixturevalue(which)
    t = tokens.load(tokens.vocabulary_path(tokencount.VOCABULARY))
    count = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), count(r["text"]), count(r["text"]) > 512) for r in d.collect())
    assert want == sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencount.count_tokens(d, frequent=frequent, sample_docs=50).collect())
    assert tokencount.count_tokens(d.where("false")).count() == 0


def test_rule_statistics_equal_brute_force(docs):
    for t in [r["text"] for r in docs.collect()] + ["", None, "a\x1cb \x0b c", "x y z u v " * 9, "l\nl\n \nl"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)} if len(windows) < 3000 else None
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)))
        if words:
            assert rules.statistics(t)[:4] == want
            if hit is not None:
                assert rules.statistics(t)[4] == len(hit)


def test_rules_find_bad_documents_and_keep_good_ones(spark, odd, empty, labels):
    d, lab = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learned = rules.fit(d, lab)
    got = rules.judge(d, learned).join(lab, "doc_id").toPandas()
    assert learned and got[got.quality == 0].kept.mean() < 0.2
    assert got[(got.quality == 1) & ~got.base_failed].kept.mean() > 0.97
    assert not any(r["kept"] for r in rules.judge(odd, learned).where("n_words < 10").collect())
    assert rules.judge(empty, learned).count() == 0 and rules.accept(odd, lab).columns == odd.columns
    assert rules.fit(d, lab.where("false")) == []


def test_toxicity_held_out_and_defined_cases(spark, odd, empty):
    d, lab = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.predict(d, lab).join(lab.select("doc_id", "toxic"), "doc_id").toPandas()
    t = got[got.held_out]
    assert t[t.toxic == 1].score.mean() > t[t.toxic == 0].score.mean() + 0.3
    model = toxicity.fit(d, lab)
    r = toxicity.score(odd, model).toPandas()
    assert len(r) == 9 and r.score.between(0, 1).all() and toxicity.score(empty, model).count() == 0
    assert toxicity.predict(d, lab.where("false")).where("score != 0").count() == 0


def test_counterfactual_penalty_draws_identity_terms_together(spark):
    toxic = [f"the gay man{i} is an idiot. word{i % 7}" for i in range(40)]
    clean = [f"the christian man{i} is kind. word{i % 7}" for i in range(60)]
    d = spark.createDataFrame(list(enumerate(toxic + clean)), "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i < 40)) for i in range(100)], "doc_id long, toxic int")
    gap = {}
    for penalty in (0.0, 50.0):
        m = toxicity.fit(d, lab, identity=["gay", "christian"], penalty=penalty)
        gap[penalty] = abs(m["weights"].get("gay", 0) - m["weights"].get("christian", 0))
    assert gap[50.0] < 0.25 * gap[0.0]


def test_url_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("key like '%7'")
    c = urlfilter.build(listed, universe, universe_size=600)  # small filter: several levels
    assert len(c.levels) > 2
    got = {r["key"] for r in universe.where(c.contains("key")).collect()}
    assert got == {r["key"] for r in listed.collect()}


def test_url_defined_cases(spark):
    d = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTP://WWW.Example.COM?x"), (5, "a://b.net/es/x"), (6, "x://net/fr/")], "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(d).collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("www.example.com", "", None, "allow"), 5: ("b.net", "/es/x", "net/es/", "block"), 6: ("net", "/fr/", "net/fr/", "block")}
    assert urlfilter.judge(d.where("false")).count() == 0


def test_warc_round_trip_of_odd_payloads(spark):
    rows = [(1, "http://a/b", "x\r\n\r\ny" * 40), (2, "http://a/c", "x\r\n\r\ny" * 40), (3, None, None), (4, "q", "\r\n\r\r\n\r\n"), (5, "q", "end\r\n" * 60), (5, "q", "end\r\n" * 60), (6, "http://h?x", "WARC/1.1\r\nContent-Length: 3\r\n\r\n"), (7, "u", "é" * 60), (8, "u", "short"), (9, "u", "short")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(d, payloads=True).collect()
    assert len(got) == len(rows) and all(r["request"] and r["metadata"] for r in got)
    html = {k: (h or "").encode() for k, _, h in rows}
    for r in got:
        full = html[r["page_id"]]
        assert r["payload_bytes"] == len(full) and r["payload_digest"] == hashlib.sha256(full).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("revisit", 1) if r["page_id"] == 2 else ("response", None))
        assert bytes(r["response"]["payload"]) == (b"" if r["page_id"] == 2 else full)
    assert warc.round_trip(d.where("false")).count() == 0


def brute_components(texts, size, percent):
    sets = {k: set(neardup.shingles(t, size).tolist()) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in sets}


def test_near_duplicates_equal_brute_force(spark, docs):
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 3, 85).collect()}
    assert got == brute_components({r["doc_id"]: r["text"] for r in docs.collect()}, 3, 85)
    rng = np.random.default_rng(2)  # chains of edits, so that stars alone don't join a group
    base, texts = [f"w{i}" for i in range(120)], {}
    for i in range(60):
        base[rng.integers(0, 120)] = f"v{i}"
        texts[i] = " ".join(base)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(d, 3, 85).collect()} == brute_components(texts, 3, 85)


def test_near_duplicates_defined_cases(odd, empty):
    rows = neardup.near_duplicates(odd, 3, 85).collect()
    assert len(rows) == 9 and {r["doc_id"]: r["n_shingles"] for r in rows}[8] == 1
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in rows if r["doc_id"] is not None)
    kept = neardup.accept(odd)
    assert kept.columns == odd.columns and kept.count() == 8 and neardup.accept(empty).count() == 0


def test_pipeline_stages_against_their_operators(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = d.columns, d.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, SF).cache()
        assert d.columns == columns and 0 < d.count() <= before
        before = d.count()
        if name == "near_duplicates":
            texts = {r["doc_id"]: r["text"] for r in d.collect()}
            assert all(k == v for k, v in brute_components(texts, 5, 80).items())
    packed = corpus_pipeline.STAGES[-1][1](spark, d, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in d.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SF).count() > 0
