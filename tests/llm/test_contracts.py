"""Operators against plain versions, on rows with nulls, blanks, copies, ties and clashing columns."""

import hashlib
import random
import re
import sys
from datetime import date
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import fixtures as fx
from lettings.llm import common, decontamination, mixing, neardup, pseudonyms, quality, rules, secrets, sharding
from lettings.llm import substrings, toxicity
from lettings.llm.fmindex import FMIndex, WaveletMatrix

CLASHES = ("size", "shard", "slot", "kept", "target", "taken", "n_words", "hits", "scores", "secrets", "key", "n", "root")


@pytest.fixture(scope="module")
def rows():
    return fx.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, fx.SCHEMA).repartition(5)
    return df.withColumns({c: F.lit("other") for c in CLASHES})


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("doc_id < -1")


def test_near_duplicates(docs, rows, nothing):
    assert fx.ordered(neardup.link(docs).collect()) == fx.ordered(fx.near_duplicates(rows))
    assert neardup.link(nothing).count() == 0


def test_near_duplicates_in_full_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SIGNATURE_BLOCK", 10)
    monkeypatch.setattr(neardup, "SET_BLOCK", 8)
    rng = random.Random(5)
    base = fx.prose(rng, 120, 9000)
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"y{rng.randrange(9999)}"
        rows.append((i, " ".join(words), "en", "a", 0))
    got = neardup.link(spark.createDataFrame(rows, fx.SCHEMA)).collect()
    assert fx.ordered(got) == fx.ordered(fx.near_duplicates(rows))


def test_close_signatures_share_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (200, neardup.SYMBOLS), dtype=np.uint16)
    b = a.copy()
    for i in range(len(b)):
        at = rng.choice(neardup.SYMBOLS, neardup.DISTANCE, replace=False)
        b[i, at] += 1
    assert (neardup.chunk_keys(a) == neardup.chunk_keys(b)).any(axis=1).all()


def test_substrings(docs, rows, nothing):
    got = substrings.cut(docs).collect()
    assert fx.ordered(got) == fx.ordered(fx.without_repeats(rows))
    assert substrings.cut(nothing).count() == 0


def test_substrings_with_many_overlaps(spark):
    rng = random.Random(8)
    pool = [fx.prose(rng, 60, 30) for _ in range(6)]
    rows = []
    for i in range(40):
        words = []
        for _ in range(rng.randrange(1, 5)):
            piece = rng.choice(pool)
            words += piece[rng.randrange(15):] + fx.prose(rng, rng.randrange(3), 30)
        rows.append((i, " ".join(words), "en", "a", 0))
    got = substrings.cut(spark.createDataFrame(rows, fx.SCHEMA)).collect()
    assert fx.ordered(got) == fx.ordered(fx.without_repeats(rows))


def test_substrings_of_a_frequent_gram(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_WORDS", 150)
    rng, sizes = random.Random(12), []
    common_words = fx.prose(rng, 40, 9000)
    rows = []
    for i in range(30):  # each pair shares its own words around the passage of all
        around = fx.prose(rng, 40, 9000)
        for k in (0, 1):
            w = fx.prose(rng, 5, 9000) + around[:20 - 3 * k] + common_words + around[20 - 3 * k:] + fx.prose(rng, 5, 9000)
            w = w if i % 3 else fx.prose(rng, 5, 9000) + around[:20] + common_words + around[20:] + fx.prose(rng, i % 2, 9000)
            rows.append((2 * i + k, " ".join(w), "en", "a", 0))
    rows += [(None, rows[4][1], "en", "a", 0), (61, rows[9][1] + " " + rows[12][1], "en", "a", 0)]
    search = substrings.search_shards

    def measured(contents, window):
        per = contents.groupBy("shard").agg(F.sum(F.octet_length("words") / 8).alias("n")).agg(F.max("n")).first()[0]
        sizes.append(per or 0)
        return search(contents, window)

    monkeypatch.setattr(substrings, "search_shards", measured)
    got = substrings.cut(spark.createDataFrame(rows, fx.SCHEMA)).collect()
    assert fx.ordered(got) == fx.ordered(fx.without_repeats(rows))
    assert sizes and max(sizes) < 600


def test_index_counts():
    rng = np.random.default_rng(2)
    symbols = rng.integers(0, 11, 500)
    matrix = WaveletMatrix(symbols, 4)
    for s in range(11):
        ends = matrix.descend(np.full(501, s), np.arange(501)) - matrix.descend(np.full(501, s), np.zeros(501, np.int64))
        assert ends.tolist() == [0, *np.cumsum(symbols == s).tolist()]
    texts = [rng.integers(0, 3, n).astype(np.uint64) for n in (30, 40, 25, 60)]
    owners = np.array([4, 2, 9, 5])
    found = FMIndex(texts, owners).earlier_matches(owners, 4)
    for i, text in enumerate(texts):
        got = {k for n, a, b in found if n == i for k in range(a, b - 3)}
        other = {tuple(t[k : k + 4]) for t, o in zip(texts, owners, strict=True) if o < owners[i] for k in range(len(t) - 3)}
        assert got == {k for k in range(len(text) - 3) if tuple(text[k : k + 4]) in other}


@pytest.mark.parametrize("block", [decontamination.BLOCK_BYTES, 300])
def test_decontamination(docs, rows, nothing, spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    w = fx.words(rows[7][1])
    items = [(1, " ".join(w[:20]).upper()), (2, " ".join(w[2:9])), (3, None), (4, ""), (5, "w1"), (6, " ".join(w[:20]) + "!"),
             (7, "ÅÄÖ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.mark(docs, bench).withColumn("n_hit", F.expr("aggregate(hits, 0L, (n, s) -> n + s.end - s.start)"))
    want = fx.benchmark_hits(rows, items)
    assert fx.ordered(got.select("doc_id", "n_words", "n_hit", "items").collect()) == fx.ordered([r[:4] for r in want])
    verdict = decontamination.with_verdict(decontamination.mark(docs, bench)).select("doc_id", "contaminated").collect()
    assert fx.ordered(verdict) == fx.ordered([(r[0], r[4]) for r in want])
    assert decontamination.mark(nothing, bench).count() == 0
    assert decontamination.mark(docs, bench.where("item_id > 9")).where("size(hits) > 0").count() == 0


SECRETS = [
    'password="abcdefgh" PASSWD : short token=12345678.', "tokentoken = abcdefgh9 secret:x api_key='AbC/+=_.-9'",
    "AKIAAKIA1234567890 AKIA123 xAKIA" + "Z" * 30, "f" * 31 + " " + "0123456789abcdef" * 3 + "G" + "a" * 32,
    "ſecret=abcdefghij toKen=abcdefghij İ token=abcdefghij", "password=abc password=abcdefgh=secret=12345678", "", None,
    "x" * 5000 + " secret = " + "9" * 5000,
]


def test_secrets(spark):
    token = "ghp_" + "A1b2C3d4E5" * 3
    token += secrets.checksum(token[4:])
    wrong = token[:-1] + ("0" if token[-1] != "0" else "1")
    texts = [*SECRETS, f"a {token} b {wrong}", f"npm_{token[4:]}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("secrets", F.lit(1))
    got = {r["doc_id"]: [tuple(s) for s in r["secrets"]] for r in secrets.scan(df).collect()}
    assert secrets.scan(df.where("doc_id < 0")).count() == 0
    for i, text in enumerate(texts):
        t = text or ""
        want = [("assign", m.start(), m.end()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 8]
        want += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        want += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
        want.sort(key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        assert [s for s in got[i] if s[0] in secrets.BASE_KINDS] == want, i
    assert [s[0] for s in got[len(SECRETS)]] == ["github"] and [s[0] for s in got[len(SECRETS) + 1]] == ["npm"]
    digest = secrets.digest(secrets.scan(df)).where("doc_id = 0").first()
    text = ",".join(f"{k}:{a}:{b}" for k, a, b in got[0])
    assert digest["spans"] == text and digest["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_rules(docs, rows, nothing):
    got = rules.judge(docs).collect()
    want = [(r[0], *fx.rule_counts(r[1])) for r in rows]
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert fx.ordered([[g[n] for n in names] for g in got]) == fx.ordered(want)
    for g in got:
        failed = g["n_words"] < 50 or 100 * g["n_repeat_words"] > 50 * g["n_words"]
        assert g["base_failed"] == failed and not (failed and g["kept"])
    assert rules.judge(nothing).count() == 0


def test_divergence(spark):
    row = spark.range(1).select(
        rules.divergence(F.array(F.lit(1), F.lit(0)), F.array(F.lit(0), F.lit(5))).alias("far"),
        rules.divergence(F.array(F.lit(1), F.lit(3)), F.array(F.lit(2), F.lit(6))).alias("same"),
        rules.divergence(F.array(F.lit(0), F.lit(0)), F.array(F.lit(0), F.lit(0))).alias("none"),
    ).first()
    assert abs(row["far"] - 1) < 1e-12 and abs(row["same"]) < 1e-12 and row["none"] == 0


def test_rules_reject_strange_texts(spark):
    rng = random.Random(4)
    good = [(i, " ".join(rng.choice("the of and to house tree river stone cloud".split()) + str(i % 3) * 0 for _ in range(20))
             + " " + " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)), "en") for i in range(30)]
    odd = (99, " ".join("".join(rng.choice("#*$%1A") for _ in range(6)) for _ in range(200)), "en")
    got = {r["doc_id"]: r["kept"] for r in rules.judge(spark.createDataFrame([*good, odd], "doc_id long, text string, lang string")).collect()}
    assert not got[99] and all(got[i] for i in range(30))


def test_mix(docs, rows, nothing):
    mixed = mixing.mix(docs)
    got = mixed.select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert fx.ordered([(g["doc_id"], g["size"]) for g in got]) == fx.ordered([(r[0], len(fx.words(r[1]))) for r in rows])
    assert all(0 <= g["taken"] <= 2 * g["size"] for g in got)
    for name in ("a", "b", "c", None):
        own = [g for g in got if g["source"] == name]
        assert abs(sum(g["taken"] for g in own) - own[0]["target"]) <= mixing.BLOCK
        assert own[0]["source_size"] == sum(g["size"] for g in own)
    again = mixing.mix(docs.repartition(3)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert fx.ordered(got) == fx.ordered(again)
    assert mixing.mix(nothing).count() == 0
    assert mixing.taken_rows(mixed, ("doc_id",)).groupBy("doc_id").count().where("doc_id is not null").agg(F.max("count")).first()[0] <= 6


def test_targets_and_seats():
    assert mixing.source_targets([100, 1000, 10], (5, 2, 1), 1.5, 2) == pytest.approx([200, 1445, 20])
    rng = random.Random(6)
    for _ in range(30):
        votes = [rng.choice([0.0, 3.0, rng.random() * 50]) for _ in range(rng.randrange(1, 9))]
        seats = rng.randrange(60)
        if not sum(votes):
            continue
        want = [0] * len(votes)
        for _ in range(seats):
            best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
            want[best] += 1
        assert mixing.apportion(votes, seats).tolist() == want


def test_quotas_add_up(spark, docs):
    plan = mixing.plan_mix(docs.withColumns({"size": common.n_words(F.col("text"))}).select("source", "size"))
    table = mixing.quotas(spark, plan).groupBy("source").agg(F.sum("quota").alias("q"), F.min("quota").alias("least")).collect()
    assert all(r["least"] >= 0 for r in table)
    assert {r["source"]: r["q"] for r in table} == dict(zip(plan.sources, plan.quotas.sum(axis=0).tolist(), strict=True))


def test_packing(docs, rows, nothing, spark):
    got = sharding.pack(docs, shards=5).collect()
    assert sorted(g["size"] for g in got) == sorted(len((r[1] or "").encode()) + 8 for r in rows)
    for s in {g["shard"] for g in got}:
        slots = sorted(g["slot"] for g in got if g["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.pack(nothing).count() == 0
    even = spark.createDataFrame([(i, f"text {i % 700} " * (1 + i % 7)) for i in range(4000)], "doc_id long, text string")
    hot = even.union(spark.createDataFrame([(9000 + i, "hot " * 30) for i in range(2000)], "doc_id long, text string"))
    got = sharding.pack(hot).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert len(got) == 24 and all(g["m"] == g["n"] - 1 for g in got)
    assert max(g["b"] for g in got) < 1.05 * min(g["b"] for g in got)
    light = sharding.pack(hot).where("text not like 'hot%'").groupBy("text").agg(F.countDistinct("shard").alias("k"))
    assert light.where("k > 1").count() == 0


def luhn(n):
    return sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(map(int, reversed(n)))) % 10 == 0


PRIVATE = [
    "card 4111 1111 1111 1111, 4111-1111-1111-1111 and 4111111111111111; not 4111111111111112.",
    "born 1987-02-28, not 1987-02-30, nor 1812-01-01; on 2024-02-29", "ip 97.51.17.173 not 300.1.1.1 nor 1.2.3.4.5",
    "call +1 (017) 555-7713 or mail a.b-1@mail7.example.com.", None, "", "nothing here", "4111111111111111!! 1987-02-28!!",
]


def test_pseudonyms(spark):
    df = spark.createDataFrame(list(enumerate(PRIVATE)), "doc_id long, text string").withColumn("n_cards", F.lit("x"))
    out = {r["doc_id"]: r for r in pseudonyms.pseudonymise(df).collect()}
    cards = re.findall(r"\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}", out[0]["text"])
    plain = [re.sub(r"\D", "", c) for c in cards]
    assert out[0]["n_cards"] == 3 and len(set(plain[:3])) == 1 and luhn(plain[0]) and plain[0] != "4111111111111111"
    assert cards[0][4] == " " and cards[1][4] == "-" and cards[3] == "4111111111111112"
    days = re.findall(r"\d{4}-\d\d-\d\d", out[1]["text"])
    assert out[1]["n_dates"] == 2 and days[1:3] == ["1987-02-30", "1812-01-01"] and "1987-02-28" not in days
    assert all(date.fromisoformat(d) for d in (days[0], days[3]))
    assert out[2]["n_addresses"] == 1 and "300.1.1.1" in out[2]["text"] and "97.51.17.173" not in out[2]["text"]
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4} or mail \S+@example\.invalid\.$", out[3]["text"]) and "555-7713" not in out[3]["text"]
    assert [out[i]["text"] for i in (4, 5, 6)] == [None, "", "nothing here"]
    assert plain[0] in out[7]["text"] and days[0] in out[7]["text"]
    assert pseudonyms.pseudonymise(df.where("doc_id < 0")).count() == 0


def test_pseudonyms_in_company(spark):
    card = "4111111111111111"
    texts = [f"{card} 123", f"{card} 12/27", "2024 4111 1111 1111 1111", "4111 1111 1111 1111 2024-01-31", "4111-1111-1111-1111 555-123-4567",
             "3782 822463 10005", "555-123-4567", "(555) 123-4567", "+1-555-123-4567", "+44 20 7946 0958", "12/31/1999", "31.12.1999",
             "1999/12/31", "12/31/1999 4111 1111 1111 1111 12th", "1 2 3 " * 300 + card]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in pseudonyms.pseudonymise(df).collect()}
    assert [(out[i]["n_cards"], out[i]["n_phones"], out[i]["n_dates"]) for i in range(len(texts))] == [
        (1, 0, 0), (1, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 0, 0), *[(0, 1, 0)] * 4, *[(0, 0, 1)] * 3, (1, 0, 1), (1, 0, 0)]
    hidden = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "123-4567", "7946 0958", "31/1999", "31.12", "2024-01-31"]
    for i, text in enumerate(texts):
        got = out[i]["text"]
        assert not any(h in got for h in hidden), got[-40:]
        assert re.sub(r"\d", "9", got) == re.sub(r"\d", "9", text)
    row = spark.createDataFrame([(0, f"{card} 97.51.17.173 {card} 12.a@mail7.example.com")], "doc_id long, text string")
    assert pseudonyms.pseudonymise(row).select("n_cards", "n_addresses", "n_mails").first()[:] == (2, 1, 1)
    assert out[0]["text"].endswith(" 123") and out[2]["text"].startswith("2024 ")


def test_pseudonyms_of_groups_cut_by_other_values(spark):
    """What stands around groups decides where they end, so alone they may read as another kind or as none."""
    day, card = "1999-12-31", "4111111111111111"
    texts = [f"up 12.5 {day} {card}", f"room 116 10.5 {day} 2000", f"v .1.2.3.4 {card}", f"1.2.2020.5 {card}", "at 150.203 11.106.155.206 97.51.17.173"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in pseudonyms.pseudonymise(df).collect()}
    assert [(out[i]["n_cards"], out[i]["n_addresses"], out[i]["n_dates"]) for i in range(5)] == [(1, 0, 1), (0, 0, 1), (1, 0, 0), (1, 0, 0), (0, 2, 0)]
    starts = ["up 12.5 ", "room 116 10.5 ", "v .1.2.3.4 ", "1.2.2020.5 ", "at 150.203 "]
    assert all(out[i]["text"].startswith(start) for i, start in enumerate(starts))
    assert not any(card in r["text"] or day in r["text"] for r in out.values())


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert df.select(pseudonyms.permuted_digits(F.col("d"), "k", "test").alias("e")).distinct().count() == 1000
    days = spark.range(pseudonyms.DAY_A * pseudonyms.DAY_B).select(
        F.date_format(F.date_add(F.to_date(F.lit(pseudonyms.FIRST_DAY)), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    out = days.select(pseudonyms.date(F.col("d"), "k").alias("e")).distinct()
    assert out.count() == pseudonyms.DAY_A * pseudonyms.DAY_B


def labelled(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        bad, toxic = i % 4 == 0, i % 3 == 0
        words = ["JUNK!!"] * 60 if bad else fx.prose(rng, 80)
        if toxic:
            words[rng.randrange(60)] = rng.choice(["nasty", "vile"])
        rows.append((i, " ".join(words), "en", f"s{i % 7}", 0))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, int(toxic)))
    labels += [(1, None, None), (None, 1, 1)]
    return (spark.createDataFrame(rows, fx.SCHEMA).repartition(4),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_quality_on_unseen_rows(spark, docs, nothing):
    df, labels = labelled(spark)
    got = quality.classify(df, labels).select("doc_id", "kept", "host_posterior", "path_posterior").collect()
    assert all(g["kept"] == (g["doc_id"] % 4 != 0) for g in got) and len(got) == 600
    assert quality.classify(nothing, labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).count() == docs.count()
    kept = quality.classify(docs, labels, keep_text=False)
    assert kept.count() == docs.count() and kept.where("kept is null").count() == 0


def test_sparse_sites_shrink(spark):
    rows = [("a", "x", 3.0)] * 200 + [("b", "x", -3.0)] * 200 + [("b", "y", 3.0), ("c", "z", -3.0)]
    df = spark.createDataFrame(rows, "__host string, __path string, __logit double")
    site, mean = quality.sites(df)
    by = {(r["__host"], r["__path"]): r for r in site.collect()}
    assert by["a", "x"]["host_posterior"] > 0.9 > 0.1 > by["b", "x"]["host_posterior"]
    assert by["b", "x"]["host_posterior"] < by["c", "z"]["host_posterior"] < mean  # one row moves a host less than 200
    out = {(r["__host"]): r for r in quality.combine(df.withColumns({"h": F.col("__host"), "p": F.col("__path")}), site, mean)
           .withColumnRenamed("h", "__host").collect()}
    assert out["a"]["posterior"] > out["a"]["document_p"]


def test_chain_on_unseen_rows(spark, docs, nothing):
    df, labels = labelled(spark)
    labels = labels.withColumn("junk", 1 - F.col("quality"))
    chain = toxicity.fit(df, labels, ("junk", "toxic"))
    got = toxicity.predict(df, chain).collect()
    right = sum((g["scores"][0] >= 0.5) == (g["doc_id"] % 4 == 0) and (g["scores"][1] >= 0.5) == (g["doc_id"] % 3 == 0) for g in got)
    assert right >= 595
    assert toxicity.predict(nothing, chain).count() == 0
    assert toxicity.predict(docs, chain).count() == docs.count()
    empty = toxicity.fit(df, labels.limit(0), ("junk", "toxic"))
    assert toxicity.predict(df, empty).where("size(scores) = 2").count() == 600


def test_later_models_use_earlier_probabilities():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    first = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float)
    second = ((x[:, 1] > 0) | (first > 0)).astype(float)
    third = second * first
    models = toxicity.fit_chain(x, np.column_stack([first, second, third]), np.arange(400) % 5, 5)
    assert [len(w) for _, w in models] == [3, 4, 5] and models[1][1][3] > 0


def test_running_total_splits_a_key(spark, monkeypatch):
    monkeypatch.setattr(common, "ROWS_PER_BUCKET", 50)
    df = spark.range(1000).withColumns({"k": F.when(F.col("id") < 900, F.lit("hot")).otherwise(F.lit("b")),
                                        "h": common.spread(F.col("id"))})
    got = common.running_total(df, "k", ["h", "id"], F.lit(2), "t", 1000).collect()
    assert sorted(g["t"] for g in got if g["k"] == "hot") == list(range(0, 1800, 2))
    by_hash = sorted((g for g in got if g["k"] == "b"), key=lambda g: g["h"])
    assert [g["t"] for g in by_hash] == list(range(0, 200, 2))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 150), (7, 7)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), 100: 100, 200: 100, 150: 100}


def test_pseudonyms_of_very_long_texts(spark):
    mega = 1 << 20
    texts = [
        "a@b" + ".c" * (mega // 2), "." * mega, "1" * mega, "1234 " * (mega // 5), "4111111111111111 " * (mega // 17),
        "a@" * (mega // 2), "a@b.com " * (mega // 64), "0000-" * (mega // 5), "1.2.3.4." * (mega // 8), "+1" * (mega // 2),
        "a@" + "b-" * (mega // 2),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(len(texts))
    out = {r["doc_id"]: r for r in pseudonyms.pseudonymise(df).collect()}
    assert out[4]["n_cards"] == mega // 17 and len(set(out[4]["text"].split())) == 1 and "4111" not in out[4]["text"][:5]
    assert out[6]["n_mails"] == mega // 64 and "b.com" not in out[6]["text"]
    assert [out[i]["text"] == texts[i] for i in (1, 2, 5)] == [True] * 3


def test_cards_between_other_marks(spark):
    cards = ["4111 1111 1111 1111", "4111  1111  1111  1111", "4111.1111.1111.1111", "4111 - 1111"]
    texts = [f"pay {c} now" for c in cards] + ["in 1234.5678 of 9012"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in pseudonyms.pseudonymise(df).collect()}
    assert [out[i]["n_cards"] for i in range(5)] == [1, 1, 1, 0, 0]
    for i in range(3):
        digits = re.sub("[^0-9]", "", out[i]["text"])
        assert len(digits) == 16 and luhn(digits) and digits != "4" + "1" * 15
        assert re.sub("[0-9]", "1", out[i]["text"]) == re.sub("[0-9]", "1", texts[i])
    many = " ".join(["7"] * 70 + ["4111", "1111", "1111", "1111"] * 40)
    got = pseudonyms.pseudonymise(spark.createDataFrame([(many,)], "text string")).first()
    assert got["n_cards"] == 40 and got["text"].split()[:70] == ["7"] * 70


def test_mix_of_a_small_source_and_a_larger_limit(spark):
    rows = [(i, "word " * 50, "big") for i in range(40)] + [(100, "few words here " * 3 + "x", "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.sum("size").alias("size")).collect()
    small = next(r for r in got if r["source"] == "small")
    assert (small["size"], small["target"], small["taken"]) == (10, 20.0, 20)
    got = mixing.mix(df, limit=3.0, share=2.5).collect()
    for name in ("big", "small"):
        own = [r for r in got if r["source"] == name]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1 + own[0]["target"] * 0.01
    assert max(r["taken"] / r["size"] for r in got) > 2


def test_rows_of_one_id_are_dealt_out(spark):
    rows = [(i, f"text {i} " * 5) for i in range(4000)] + [(None, "the same text " * 4)] * 2000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn("source", F.lit("s"))
    per = sharding.pack(df).groupBy("shard").agg(F.sum("size").alias("b"), F.max("slot").alias("m"), F.count("*").alias("n")).collect()
    assert len(per) == 24 and all(r["m"] == r["n"] - 1 for r in per)
    assert max(r["b"] for r in per) < 1.05 * min(r["b"] for r in per)
    numbered = common.numbered_copies(df, ["doc_id", "text"], "nth", 1).groupBy("doc_id").agg(
        F.min("nth").alias("a"), F.max("nth").alias("b"), F.countDistinct("nth").alias("n")).collect()
    assert all((r["a"], r["b"] + 1) == (0, r["n"]) and r["n"] == (2000 if r["doc_id"] is None else 1) for r in numbered)
    got = mixing.mix(df).select("doc_id", "size", "taken")
    assert fx.ordered(got.collect()) == fx.ordered(mixing.mix(df.repartition(3)).select("doc_id", "size", "taken").collect())


def test_components_of_a_shuffled_path(spark, monkeypatch):
    n, rounds = 3000, []
    order = list(range(n))
    random.Random(3).shuffle(order)
    stable = common.stable
    monkeypatch.setattr(common, "stable", lambda df: rounds.append(1) or stable(df))
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(n, n + 1), (n + 2, n + 2)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(edges, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(n), 0), n: n, n + 1: n}
    assert len(rounds) <= 2 + 3 * 20


def test_matches_longer_than_the_usual_window(spark):
    rng = random.Random(21)
    shared = fx.prose(rng, 140, 3)
    rows = [(i, " ".join(fx.prose(rng, 20, 3) + shared[: 60 + 10 * i] + fx.prose(rng, 90, 3)), "en", "a", 0) for i in range(9)]
    for window in (50, 80, 100):
        got = substrings.cut(spark.createDataFrame(rows, fx.SCHEMA), window=window).collect()
        assert fx.ordered(got) == fx.ordered(fx.without_repeats(rows, window))
    with pytest.raises(ValueError, match="need more"):
        FMIndex([np.arange(9).astype(np.uint64)], np.array([1])).earlier_matches(np.array([1]), 65)


def test_texts_that_share_a_hash_are_told_apart(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "doc_id long, text string")
    monkeypatch.setattr(substrings, "second_hash", lambda text: F.coalesce(F.xxhash64(text), F.lit(0)))
    name, ids = substrings.identified(df, "text", "doc_id")
    assert ids.count() == 3 and df.select(name.alias("c")).distinct().count() == 3
    real = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: real(*c) if len(c) > 1 else F.lit(7).cast("long"))
    monkeypatch.setattr(substrings, "second_hash", lambda text: real(F.lit(1), text))
    name, ids = substrings.identified(df, "text", "doc_id")
    assert ids.count() == 3 and df.select(name.alias("c")).distinct().count() == 3


def test_near_duplicate_stage_removes_rows_without_id_and_repeated_rows(spark):
    import corpus_pipeline

    rng = random.Random(13)
    base, other = fx.prose(rng, 80, 9000), fx.prose(rng, 80, 9000)
    close = [*base[:40], "y", *base[41:]]  # 71 of 81 shingles
    rows = [
        (5, " ".join(base), "en", "a", 0), (5, " ".join(base), "en", "a", 0), (5, "  ".join(base), "en", "a", 0),
        (None, " ".join(close), "en", "a", 0), (None, " ".join(other), "en", "a", 0), (None, " ".join(other), "en", "b", 0),
        (7, " ".join(base).upper(), "de", "a", 0), (8, None, "en", "a", 0), (8, None, "en", "a", 0), (None, "", None, None, None),
    ]
    df = spark.createDataFrame(rows, fx.SCHEMA).repartition(4)
    got = corpus_pipeline.deduplicated(spark, df, "").collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["5", "8", "8", "None", "None"]
    assert sum(r["text"] == " ".join(other) for r in got) == 1


def test_recall_against_all_pairs(spark):
    """Near copies at 80 to 90 %: all of the pairs that any two documents make are linked."""
    rng = random.Random(17)
    rows = []
    for i in range(0, 1200, 2):
        words = fx.prose(rng, 204, 90_000)
        copy = list(words)
        for at in rng.sample(range(2, 202, 5), 5 if i % 4 else 4):  # some 180 or 184 of 200 shingles: 81 to 85 %
            copy[at] = f"z{rng.randrange(10**9)}"
        rows += [(i, " ".join(words), "en", "a", 0), (i + 1, " ".join(copy), "en", "a", 0)]
    got = neardup.link(spark.createDataFrame(rows, fx.SCHEMA), percent=80).collect()
    assert fx.ordered(got) == fx.ordered(fx.near_duplicates(rows, 80))
    assert sum(not r["kept"] for r in got) >= 300
