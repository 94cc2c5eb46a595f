"""Sharding, mixing, chat formatting and WARC against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lociforge.llm import chat, jaccard, mixing, sharding, warc

TEXTS = ["", None, "a", "b b", "c " * 50, "d " * 400, "é ñ"] + [f"w{i} " * (i % 37 + 1) for i in range(200)] + ["copy " * 30] * 60


def docs(spark, schema):
    return spark.createDataFrame([(i, t, "en", [None, "", "s1", "s2"][i % 4], 0) for i, t in enumerate(TEXTS)] + [(0, "", "en", None, 0)] * 2, schema)


def test_difference_is_balanced():
    rng = np.random.default_rng(0)
    sizes = rng.lognormal(6, 1.5, 500).astype(np.int64) + 1
    bins, sums = sharding.difference(np.concatenate([sizes[:, None], np.zeros((500, 7), np.int64)], axis=1))
    assert np.array_equal(np.bincount(bins[:, 0], weights=sizes, minlength=8).astype(np.int64), sums)
    assert sums.max() - sums.min() <= 2 and all(sorted(b) == list(range(8)) for b in bins)


def test_shards(spark, docs_schema):
    for chunk in (20_000, 20):
        rows = sharding.shard_documents(docs(spark, docs_schema), 8, chunk=chunk).collect()
        assert len(rows) == len(TEXTS) + 2
        of, slots, size = {}, defaultdict(list), Counter()
        for r in rows:
            assert r["size"] == len((r["text"] or "").encode()) + 1
            assert of.setdefault(r["text"], r["shard"]) == r["shard"]
            slots[r["shard"]].append(r["slot"])
            size[r["shard"]] += r["size"]
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        copies = 60 * len("copy " * 30) + 60
        rest = [v for v in size.values() if v < copies]
        assert max(size.values()) <= copies + 50 and max(rest) - min(rest) <= 200
    assert sharding.shard_documents(docs(spark, docs_schema).where("false")).count() == 0


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, None: 20, "d": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, left, open_ = {}, float(sum(sizes.values())), set(order)
    while True:  # reshare by weight until none is above
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            want |= {s: left * weight[s] / total for s in open_}
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3.0 * sizes[s] for s in over)
        open_ -= over
    assert all(abs(got[s] - want[s]) < 1e-6 for s in order)


def test_mix(spark, docs_schema):
    d = docs(spark, docs_schema)
    plan = mixing.plan_rows(d).collect()
    again = mixing.plan_rows(d.repartition(7)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in plan) == sorted((r["doc_id"], r["copies"]) for r in again)
    taken, target, most = Counter(), {}, {}
    for r in plan:
        assert r["size"] == len((TEXTS[r["doc_id"]] or "").split()) and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
        most[r["source"]] = max(most.get(r["source"], 0), r["size"])
    assert all(abs(taken[s] - target[s]) <= 3 * most[s] for s in target)
    out = mixing.mix(d)
    assert out.columns == d.columns and out.count() == sum(r["copies"] for r in plan)
    assert mixing.plan_rows(d.where("false")).count() == 0


def test_native_plans(spark, docs_schema):
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    for df in (mixing.mix(docs(spark, docs_schema)), chat.format_conversations(turns)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "&lt;s>", "&amp;lt;", "<", "a<<SYS>>b", "x [ y", "", None, "[/ROLE][SAYS]", "<</SYS>>", "é" * 20_000, "[INST", "INST]", "</s", "&lsqb;INST]"]
    roles = ["user", "assistant", "system", "tool", "[ROLE]", "", None]
    rows = [(c, t, roles[(c + t) % 7], nasty[(c * 3 + t) % len(nasty)]) for c in range(30) for t in range(8)] + [(None, 1, "user", "a"), (5, 1, "user", "tie"), (5, 1, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    f = chat.format_conversations(df).cache()
    assert f.where("not round_trip").count() == 0
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t, r or "", x or ""))
    for r in chat.read_back(f).collect():
        turns = sorted(want[r["conv_id"]])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [x[1:] for x in turns]
        assert r["loss_text"] == "".join(x for _, role, x in turns if role == "assistant")
    plain = spark.createDataFrame([(1, 0, "user", "a < b & c [1]")], df.schema)
    assert chat.format_conversations(plain).first()["formatted"] == "[INST]a < b & c [1][/INST]"
    assert chat.format_conversations(df.where("false")).count() == 0


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 1200
    rows = [(1, "http://a/", big), (2, "http://b/ c", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n" + "é" * 700), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n" + "é" * 700), (None, "n", "z" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_warc(df, str(tmp_path / "w"), records_a_file=4)
    got = warc.resolve(warc.captures(warc.read_warc(spark, str(tmp_path / "w")))).collect()
    assert len(got) == len(rows)
    for r in got:
        i, url, html = next(x for x in rows if x[0] == r["page_id"])
        raw = (html or "").encode()
        assert (r["payload"], r["payload_bytes"], r["payload_digest"], r["url"]) == (html or "", len(raw), hashlib.sha1(raw).hexdigest(), url)
        again = html == big and i != 3
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if again else ("response", None))
        assert r["request"]["head"].startswith("GET ")
    one = b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    for content in (one * 3, zlib.compress(one * 3, wbits=31), zlib.compress(one, wbits=31) * 3):
        assert [b for _, b in warc.records(content)] == [b"hi"] * 3
    assert warc.transactions(df.where("false")).count() == 0


def test_unequal_small_payloads_are_responses(spark):
    df = spark.createDataFrame([(1, "u", "a" * 999), (2, "u", "a" * 999), (3, "u", "a" * 1000), (4, "u", "a" * 1000)], "page_id long, url string, html string")
    kinds = Counter(r["value"].split("WARC-Type: ")[1].split("\r")[0] for r in warc.transactions(df).where(F.col("value").contains("WARC-Payload-Digest")).collect())
    assert kinds == {"response": 3, "revisit": 1}


def named(spark, d, names):
    """d with a column of each name that holds the row's id and that name."""
    return d.select("*", *[F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(n)).alias(n) for n in names])


INTERNAL = ["_g", "_k", "_h", "_n", "_s", "_t", "_u", "_c", "_b", "_first", "_nth", "_at", "_copy", "_copies", "_rank", "_source", "_class", "_salt", "_each", "_before", "_text", "_id", "_f1", "_gone", "__g", "size", "target", "copies", "k", "s", "h", "n", "u", "f1", "first", "each", "before", "component_id"]


def test_columns_of_any_name_stay(spark, docs_schema):
    d = named(spark, docs(spark, docs_schema), INTERNAL)
    whole = lambda df, cols: Counter(tuple(r[c] for c in cols) for r in df.collect())
    kept = [c for c in d.columns if c not in ("size", "shard", "slot")]
    got = sharding.shard_documents(d)
    assert set(got.columns) == {*kept, "size", "shard", "slot"} and whole(got, kept) == whole(d, kept)
    plan = Counter()
    for r in mixing.plan_rows(d).collect():
        plan[r["doc_id"]] += r["copies"]
    out = mixing.mix(d)
    taken = out.collect()
    assert out.columns == d.columns and Counter(r["doc_id"] for r in taken) == +plan
    assert all(r[c] == f"{r['doc_id']}{c}" for r in taken for c in INTERNAL)
    left = jaccard.distinct_documents(d, 3, 90)
    rows = left.collect()
    assert left.columns == d.columns and all(r[c] == f"{r['doc_id']}{c}" for r in rows for c in INTERNAL)
    assert len({r["text"] for r in rows if r["text"]}) == len([r for r in rows if (r["text"] or "").strip()])


def test_mix_of_repeated_rows_and_write_shards(spark, docs_schema, tmp_path):
    rows = [(i % 3, f"w{i % 3} " * 4, "en", "s", 0) for i in range(60)] + [(None, None, "en", None, 0)] * 2
    d = spark.createDataFrame(rows, docs_schema)
    total = sum(r["copies"] for r in mixing.plan_rows(d).collect())
    out = mixing.mix(d).collect()
    assert len(out) == total and sum(len(r["text"].split()) for r in out if r["text"]) == 60 * 4
    sharding.write_shards(d, str(tmp_path / "s"), shards=4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 62 and sorted((r["shard"], r["slot"]) for r in back.collect()) == sorted((r["shard"], r["slot"]) for r in sharding.shard_documents(d, 4).collect())


def test_shards_against_every_split(spark, docs_schema):
    """The spread of sizes is that of the best split of a few groups over two shards, within what differencing promises."""
    rng = np.random.default_rng(5)
    texts = ["x" * int(n) for n in rng.integers(50, 400, 12)]
    rows = sharding.shard_documents(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], docs_schema), 2).collect()
    sizes = np.array([len(t) + 1 for t in texts])
    total = Counter()
    for r in rows:
        total[r["shard"]] += r["size"]
    best = min(abs(int(sizes.sum()) - 2 * int(sizes[[bool(m >> i & 1) for i in range(12)]].sum())) for m in range(1 << 12))
    assert best <= abs(total[0] - total[1]) <= best + 30
