"""The training-data problems on small fixtures against brute force."""

import random
import unicodedata

import numpy as np
import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from sparkademia.llm.eliasfano import EliasFano, SeenKeys
from sparkademia.llm import canonical, leakage, mixing, mojibake, queries, seen, survivor

U64 = np.uint64


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, data, name):
    df = queries.queries()[name](spark, data)
    sql = queries.oracle_sql().get(name)
    if sql:
        same(df, connect(data), sql)
    else:
        df.collect()


# --- Elias-Fano and seen keys -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("n,top", [(0, 2), (1, 2**63), (7, 16), (1000, 2**63), (5000, 6000), (3000, 2**40)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, top, n, dtype=np.int64).astype(U64) * U64(1 if top < 2**63 else 2))
    ef = EliasFano(keys)
    assert (ef.decode() == keys).all()
    probes = np.concatenate([keys, rng.integers(0, top, 500, dtype=np.int64).astype(U64), np.array([0, 2**64 - 1], U64)])
    assert (ef.successor_index(probes) == np.searchsorted(keys, probes)).all()
    assert (ef.contains(probes) == np.isin(probes, keys)).all()
    again = EliasFano.from_bytes(ef.to_bytes())
    assert (again.contains(probes) == np.isin(probes, keys)).all()
    fresh = np.setdiff1d(probes, keys)
    assert (ef.merge(fresh).decode() == np.union1d(keys, probes)).all()
    if len(keys) > 900 and top == 2**63:
        assert ef.bytes * 8 / len(keys) < 2 + 64 - np.log2(len(keys)) + 3


def test_seen_keys_stream():
    rng = random.Random(3)
    s, known = SeenKeys(least=50), set()
    for _ in range(40):
        batch = [rng.randint(0, 900) for _ in range(30)]
        want = []
        for k in batch:
            want.append(k in known)
            known.add(k)
        assert s.add(np.array(batch, U64)).tolist() == want


KEYS = "id long, domain string, url string, h string, repeated string"


def test_seen_before(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["x", "y", None, ""]) if rng.random() < 0.5 else f"u{rng.randint(0, 40)}", "h", "r") for i in range(300)]
    rng.shuffle(rows)
    rows += [(None, "a", "x", "", ""), (5000, "new", "n", "", ""), (5000, "new", "n", "", "")]
    got = {r.id for r in seen.seen_before(spark.createDataFrame(rows, KEYS), ["domain", "url"], "id", least=4).collect()}
    first = {}
    for i, d, u, *_ in rows:
        if i is not None:
            first[d, u] = min(i, first.get((d, u), i))
    assert got == {i for i, d, u, *_ in rows if i is not None and i > first[d, u]}
    assert seen.seen_before(spark.createDataFrame([], KEYS), ["domain", "url"], "id").count() == 0
    r = seen.error_report(spark.createDataFrame([], KEYS), ["domain", "url"], "id").first()
    assert (r.total_rows, r.wrong_rate) == (0, 0.0)


def test_sets_are_kept_between_batches(spark):
    from sparkademia.session import Workspace

    rng = random.Random(14)
    rows = [(i, rng.choice(["a", "b", None]), f"u{rng.randint(0, 300)}", "h", "r") for i in range(900)]
    want = {r.id for r in seen.seen_before(spark.createDataFrame(rows, KEYS), ["domain", "url"], "id").collect()}
    store, got = seen.SeenStore(Workspace(spark, "seen"), 3, least=16), set()
    for start in (0, 300, 600):
        got |= {r.id for r in store.batch(spark.createDataFrame(rows[start : start + 300], KEYS), ["domain", "url"], "id").collect()}
    assert got == want and len(want) > 200
    assert store.sets.count() <= 3


def test_memory_a_key():
    import tracemalloc

    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 2_000_000, dtype=np.int64).astype(U64)
    tracemalloc.start()
    s = SeenKeys()
    for i in range(0, len(keys), 50_000):
        s.add(keys[i : i + 50_000])
    s.flush()
    per_key, peak = s.bytes / s.set.n, tracemalloc.get_traced_memory()[1] / s.set.n
    tracemalloc.stop()
    print("bytes a key: kept", round(per_key, 2), "peak", round(peak, 2))
    assert per_key < 6.6 and peak < 24


def test_error_rate_is_measured(spark):
    df = spark.range(3000).select("id", F.col("id").cast("string").alias("domain"), F.lit("u").alias("url"))
    r = seen.error_report(df, ["domain", "url"], "id", bits=20).first()
    assert 0 < r.wrong_answers < 20 and abs(r.expected_wrong - 4.29) < 0.1


# --- copies and survivors ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("a,b", [
    ("Applied Earth Science MSc", " Msc, Applied-Earth Science"), ("Génie Électrique MSc", "MSC - " + unicodedata.normalize("NFD", "GÉNIE ÉLECTRIQUE")), ("情報科学 修士", "修士: 情報科学"),
    ("Marine​Law (LLM) *", "L.L.M.: marine law"), ("Drama MA", "[M.A.] dra­ma"), ("Law Ph.D.", "« phd law »"), ("Foo M. Sc.", "MSc Foo"), ("情報科学修士", "修士 情報科学"),
])
def test_equal_names(a, b):
    assert canonical.name_key(a) == canonical.name_key(b)


@pytest.mark.parametrize("a,b", [("Law and Politics BA", "Politics and Law BA"), ("Law BA", "Law MA"), ("Génie BA", "Genie BA"), ("Drama MA", "Drama"), ("Law", "")])
def test_different_names(a, b):
    assert canonical.name_key(a) != canonical.name_key(b)


def test_url_keys():
    k = canonical.url_key
    assert k("https://a.example/X-y_z/?b=2&a=1") == k(" HTTPS://A.EXAMPLE//x-y-z?a=1;b=2&") == k("<https://a.example/xyz?a=1&b=2>")
    assert k("https://a.example/x?a=1&b=12") != k("https://a.example/x?a=11&b=2") and k("http://a.example") != k("https://a.example")


def test_keys_of_ascii_rows_are_the_same_in_spark_and_python(spark):
    rng = random.Random(21)
    pieces = ["MSc", "m.sc.", "M Sc", "d p h i l", "BA", "ma", "m ba", "Law", "(Data)", "x-1", "L. L. M.", "ed d", "", " ", "|", "..."]
    urls = ["https://a.example/", "/p?", "?b=2", "&a=1", ";c", "=", "?", "A=%20", "#x", "\n"]
    rows = []
    for i in range(800):
        n = " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 5)))
        rows.append((i, rng.choice([None, 1, 12]), rng.choice([n, n, None]), "".join(rng.choice(urls) for _ in range(rng.randint(0, 6))), rng.choice([None, "", "Law & Co", "x"])))
    df = spark.createDataFrame(rows, "id int, university_id int, program_name string, source_url string, course_type string")
    import hashlib

    got = {r.id: bytes(r.k) for r in canonical.with_program_key(df, "id").withColumnRenamed("key", "k").collect()}
    for i, u, *r in rows:
        assert got[i] == hashlib.md5(canonical._canonical(None if u is None else str(u), *r).encode()).digest(), r


PROGRAMS = "id int, university_id int, program_name string, source_url string, course_type string, last_seen timestamp_ntz, quality_flag string, is_online boolean, key string, copies int"


def _programs(spark, n=400):
    from datetime import datetime, timedelta

    rng = random.Random(6)
    out = []
    for i in range(n):
        g = rng.choice([0] * 12 + list(range(1, 120)))
        name = rng.choice(["{0} Law BA", "BA {0}-LAW", " {0} law, b.a."]).format(f"x{g}")
        seen_at = rng.choice([None, datetime(2026, 1, 1) + timedelta(days=rng.randint(0, 40))])
        out.append((i, rng.choice([None, 1]) if g == 5 else g % 3, name if g != 7 else None, f"https://h.example/{g}", "law", seen_at, rng.choice(["high", "low", None]), rng.choice([True, False, None, None]), "k", 1))
    return out


def _groups(rows):
    out = {}
    for r in rows:
        out.setdefault(canonical._canonical(None if r[1] is None else str(r[1]), *r[2:5]), []).append(r)
    return out.values()


def test_copies(spark):
    rows = _programs(spark)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, PROGRAMS)
    got = {(r.first_id, r.copy_id) for r in canonical.copies_of(df, hot_share=0.05).collect()}
    want = {(min(x[0] for x in g), r[0]) for g in _groups(rows) for r in g if r[0] > min(x[0] for x in g)}
    assert got == want and len(want) > 100
    one = {r.first_id: r.copies for r in canonical.collapse(df, batches=3).collect()}
    assert one == {min(x[0] for x in g): len(g) for g in _groups(rows)}
    empty = spark.createDataFrame([], PROGRAMS)
    assert canonical.copies_of(empty).count() == 0 and canonical.collapse(empty).count() == 0


def test_ledger_batches_agree(spark):
    df = spark.createDataFrame(_programs(spark, 120), PROGRAMS)
    a, b = (sorted(map(tuple, canonical.collapse(df, batches=n).collect()), key=repr) for n in (1, 5))
    assert a == b


def test_survivors(spark):
    rows = _programs(spark)
    df = spark.createDataFrame(rows, PROGRAMS)
    trust = {"high": 2, "low": 1, None: 0}
    clear, best = set(), {}
    for g in _groups(rows):
        low = lambda r: r[5].timestamp() if r[5] else 0
        top = sorted(g, key=lambda r: (-low(r), -trust[r[6]], -((r[5] is not None) + (r[7] is not None) + (r[6] is not None)), r[0]))
        w, rest = top[0], top[1:]
        best[w[0]] = (len(g), max(trust[r[6]] for r in g))
        if rest and w[5] and all(low(r) < low(w) for r in rest) and all(trust[r[6]] <= trust[w[6]] for r in rest) and (w[7] is not None or all(r[7] is None for r in g)):
            clear.add(w[0])
    assert {r.id for r in survivor.clear_survivors(df).collect()} == clear and clear
    got = {r.id: (r.copies, trust[r.quality_flag]) for r in survivor.survivors(df).collect()}
    assert got == best
    assert survivor.survivors(spark.createDataFrame([], PROGRAMS)).count() == 0


# --- leaked items -----------------------------------------------------------------------------------------------------


def _words(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("klmnopqrst") + str(rng.randint(0, 99)) for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(8)
    items = [_words(rng, rng.randint(40, 90)) for _ in range(12)]
    docs, want = [], set()
    for d in range(160):
        text = _words(rng, rng.choice([0, 10, 200, 1500]))
        if d % 2:
            i, n = rng.randrange(12), rng.choice([12, 17, 18, 25, 38])
            a = rng.randint(0, len(items[i]) - n)
            part = list(items[i][a : a + n])
            for k in range(n // 8):  # spread exchanges
                part[8 * k + 3] = "other"
            cut = rng.randint(0, len(text))
            text[cut:cut] = part
            h = "\n".join(text) if d % 3 else "<p>" + "</b> ".join(w.upper() + "," for w in text)
            if n >= 18:
                want.add((d, i))
        else:
            h = " ".join(text)
        docs.append((d, h, "clash"))
    docs += [(900, None, ""), (901, "", ""), (None, "x", ""), (1, docs[1][1], "")]
    it = [(i, " ".join(w), "s", "x") for i, w in enumerate(items)] + [(50, None, "s", "x"), (51, "too short", "s", "x"), (None, "x " * 40, "s", "x")]
    d, t = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(it, "item_id long, text string, suite string, doc_id string")
    got = leakage.leaks(d, t)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    crowded = leakage.leaks(d, t, leakage.LeakParams(filter_bits=19))  # a filter far too small lets more through
    assert {(r.doc_id, r.item_id) for r in crowded.collect()} == want
    assert leakage.leaks(d.limit(0), t).count() == 0 and leakage.leaks(d, t.limit(0)).count() == 0
    assert leakage.leak_report(d, t).agg(F.sum("documents")).first()[0] == len(want)


def test_leak_words():
    assert leakage.words_of("<b>Café</b>&nbsp;d’Été STRASSE_x") == ["cafe", "d", "ete", "strasse", "x"]


# --- mixing -----------------------------------------------------------------------------------------------------------


def test_quotas():
    t = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4)]
    assert mixing.quotas({"a": 1000, "b": 100, "c": 1000}, t) == {"a": 333, "b": 200, "c": 133}
    assert mixing.quotas({"a": 1000, "b": 100, "c": 1000}, t, 1000) == {"a": 500, "b": 200, "c": 200}
    assert mixing.quotas({"a": 10}, t) == {"a": 10, "b": 0, "c": 0} and mixing.quotas({}, t) == {"a": 0, "b": 0, "c": 0}


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_splitting_tree(shards):
    blocks = [40, 7, 0]
    leaves = list(mixing.splitting_tree(blocks, shards, 1))
    assert [x[0] for x in leaves] == list(range(shards))
    for i, n in enumerate(blocks):
        assert sum(x[2][i] for x in leaves) == n and all(x[2][i] >= 0 for x in leaves)
        assert [x[3][i] for x in leaves] == [sum(y[2][i] for y in leaves[:k]) for k in range(shards)]
    sizes = [sum(x[2]) for x in leaves]
    assert max(sizes) - min(sizes) <= shards


def test_hypergeometric_beyond_numpys_limit(monkeypatch):
    rng = np.random.default_rng(5)
    big = [mixing.hypergeometric(rng, 6 * 10**12, 4 * 10**12, 10**12) for _ in range(300)]
    sd = (10**12 * 0.6 * 0.4 * 0.9) ** 0.5
    assert abs(np.mean(big) - 6e11) < 4 * sd / 300**0.5 and 0.85 < np.std(big) / sd < 1.15
    leaves = list(mixing.splitting_tree([3 * 10**10, 10**10, 5], 64, 2))
    assert [sum(x[2][i] for x in leaves) for i in range(3)] == [3 * 10**10, 10**10, 5]
    # the way beyond the limit against the exact distribution, on small numbers
    real = np.random.default_rng(7)
    small = []
    for _ in range(4000):
        a, b = int(real.binomial(30, 20 / 50)), int(real.binomial(20, 20 / 50))
        small.append(a - mixing.hypergeometric(real, a, b, a + b - 20) if a + b > 20 else a + mixing.hypergeometric(real, 30 - a, 20 - b, 20 - a - b))
    exact = np.random.default_rng(8).hypergeometric(30, 20, 20, 4000)
    assert abs(np.mean(small) - 12) < 0.15 and abs(np.std(small) - np.std(exact)) < 0.1


DOCS = "doc_id long, text string, source string, tokens string, shard string"


def test_mix(spark):
    rng = random.Random(9)
    rows = [(i, "word " * rng.randint(1, 40), rng.choice(["Big One", "big-one", "small", None, "other"]) if i % 9 else "small", "x", "y") for i in range(1500)]
    rows += [(3000, None, "small", "", ""), (3001, "", "small", "", ""), (None, "x", "small", "", ""), rows[0]]
    targets = spark.createDataFrame([("big_one", 0.6, 1), ("small", 0.4, 3)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(rows, DOCS)
    m = mixing.mix(df, targets, shard_tokens=3000).cache()
    report = {r.source: r for r in mixing.shares(m, targets).collect()}
    assert all(r.reached and r.most_uses <= r.max_repeats for r in report.values())
    assert m.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    assert m.select("shard").distinct().count() > 3
    w = m.groupBy("shard").agg(F.count("*").alias("n"), F.max("position").alias("p")).collect()
    assert all(r.n == r.p + 1 for r in w)
    m.unpersist()
    short = mixing.mix(df, targets, total=10**9)
    assert {r.most_uses for r in mixing.shares(short, targets).collect()} == {1, 3}
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0


def test_a_scarce_source_does_not_shrink_the_mixture(spark, tmp_path):
    rows = [(i, "word " * 50, "a" if i % 2 else "b", "x", "y") for i in range(400)] + [(1000, "word " * 50, "rare", "x", "y")]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    targets = [("a", 0.5, 2), ("b", 0.3, 2), ("rare", 0.2, 3)]
    spark.createDataFrame(targets, "source string, target_share double, max_repeats int").write.parquet(str(tmp_path / "mix_targets.parquet"))
    r = {x.source: x for x in queries.queries()["p9_shares"](spark, str(tmp_path)).collect()}
    each = r["rare"].tokens / r["rare"].uses
    assert r["rare"].uses == r["rare"].most_uses == 3 and not r["rare"].reached
    assert abs(r["a"].tokens - 0.5 * 401 * each) <= each and abs(r["b"].tokens - 0.3 * 401 * each) <= each


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "a b " * 60_000), (5, "x" * 300_000)], "i int, text string")
    n = {r.i: r.tokens for r in mixing.token_counts(df, "text").collect()}
    assert 2 <= n[1] <= 4 and n[2] == n[3] == 0 and 100_000 < n[4] < 250_000 and n[5] > 10_000


# --- garbled text -----------------------------------------------------------------------------------------------------

CLEAN = ["La matrícula cuesta 300 € – año próximo", "Die Prüfung für spätere Gebühren", "L’élève choisit une spécialité", "出願書類は期日までに提出してください。", "zajęcia odbywają się w ciągu miesiąca", "It’s taught by a small team"]


@pytest.mark.parametrize("k", range(len(mojibake.WRONG_READINGS)))
def test_chains_are_reversible(k):
    true, read = mojibake.WRONG_READINGS[k]
    if read == "utf-8":
        return
    for text in CLEAN:
        g = mojibake.garble(text, true, read)
        if g is not None and "�" not in g:
            assert mojibake.ungarble(g, k) in (text, None)


def test_garbled_documents(spark):
    odd = ["ＡＢＣ１２３ ｶﾀｶﾅ", "Ångström Hall, naïve façade", "ATENÇÃO: INSCRIÇÃO NÃO SERÁ", "PÂTISSERIE ET HÔTELLERIE", "plain ascii", "", None]
    rows = [(i, t) for i, t in enumerate((CLEAN * 3) + odd)]
    bad = {}
    for j, (true, read) in enumerate([("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp850"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("utf-8", "cp932"), ("cp932", "cp1252"), ("euc_jp", "latin-1"), ("cp1252", "utf-8")]):
        for n, t in enumerate(CLEAN):
            g = mojibake.garble(t, true, read)
            if g is not None:
                bad[1000 + 10 * j + n] = (g, t)
    twice = mojibake.garble(mojibake.garble(CLEAN[0], "utf-8", "cp1252"), "utf-8", "cp1252")
    bad[2000] = (twice, CLEAN[0])
    rows += [(i, g) for i, (g, _) in bad.items()] + [(None, "Ã©"), (1000, bad[1000][0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, token string")
    assert {r.doc_id for r in mojibake.garbled_documents(df).collect()} == set(bad)
    restored = {r.doc_id: r for r in mojibake.restored_documents(df).collect()}
    assert set(restored) == set(bad)
    lossless = [i for i, (g, _) in bad.items() if "�" not in g]
    right = [i for i in lossless if restored[i].text == bad[i][1]]
    assert len(right) >= 0.9 * len(lossless), [(restored[i].text, bad[i]) for i in lossless if i not in right][:3]
    assert mojibake.garbled_documents(df.limit(0)).count() == 0


def test_planted_documents_are_restored(spark):
    """Clean documents of the test data garbled by chains that lose nothing, among all the others."""
    from sparkademia.session import table

    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").where("text IS NOT NULL")
    bad = {r.doc_id for r in mojibake.garbled_documents(docs).collect()}
    rng = random.Random(3)
    clean = [r for r in docs.collect() if r.doc_id not in bad and not r.text.isascii()]
    planted = {}
    for r in rng.sample(clean, 60):
        k = rng.choice([0, 0, 1, 2, 4, 6, 9, 13])
        g = mojibake.garble(r.text, *mojibake.WRONG_READINGS[k])
        if len(planted) % 4 == 0:
            g = mojibake.garble(g, *mojibake.WRONG_READINGS[0])
        if g is not None and "\ufffd" not in g:
            planted[10**6 + r.doc_id] = (g, r.text)
    more = spark.createDataFrame([(i, g) for i, (g, _) in planted.items()], "doc_id long, text string")
    out = {r.doc_id: r.text for r in mojibake.restored_documents(docs.union(more)).where(f"doc_id >= {10**6}").collect()}
    right = sum(out.get(i) == t for i, (_, t) in planted.items())
    print("planted", len(planted), "found", len(out), "restored", right)
    assert len(planted) > 40 and len(out) >= 0.95 * len(planted) and right >= 0.8 * len(planted)
