"""Token counts, token files, decontamination, sharding and mixing against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, documents
from vertexloom.llm.decontaminate import Phrases, contamination, find_spans, is_contaminated
from vertexloom.llm.mixing import MixSettings, mix, mixed_documents
from vertexloom.llm.sharding import ShardSettings, shards, write_shards
from vertexloom.llm.token_count import count_tokens
from vertexloom.llm.token_output import PieceIds, read_token_ids, token_ids_round_trip, write_token_ids

ALPHABET = ["a", "the", "ing", " ", "  ", "\n", "'s", "é", "ß", "日本", "123", ".", "!!", "<|endoftext|>", "<s>", "▁", "😀", "\x00", "\x1c", "\xa0", "%%%", "Word", "WORD"]


def texts(seed, n=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [*ODD, *enumerate([*texts(1), "x" * 5000, "ab" * 3000], 100)]
    want = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows]
    assert by_id(count_tokens(documents(spark, rows, extra=True), path)) == sorted(want, key=str)
    assert count_tokens(documents(spark, []), path).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [*[r for r in ODD if r[0] is not None], *enumerate(texts(2), 100)]
    random.Random(1).shuffle(rows)
    found = sorted(tuple(r) for r in token_ids_round_trip(documents(spark, rows, extra=True), path, str(tmp_path / "ids")).collect())
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert found == want
    one = read_token_ids(spark, str(tmp_path / "ids")).where("doc_id = 5").collect()[0]
    assert library.decode(one["ids"][:-1]) == "A b C d E f g"


def test_token_files_odd_ids(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = token_ids_round_trip(documents(spark, ODD), path, str(tmp_path / "a")).collect()
    assert sorted((r["start"], r["start"] + r["n_tokens"]) for r in found)[0][0] == 0 and len(found) == len(ODD)
    assert [r["start"] for r in found if r["doc_id"] is None] == [0]
    write_token_ids(documents(spark, []), path, str(tmp_path / "b"))
    assert token_ids_round_trip(documents(spark, []), path, str(tmp_path / "c")).count() == 0


def test_token_file_has_indexes(spark, tmp_path):
    import pyarrow.orc as orc

    write_token_ids(documents(spark, [(i, "some words here") for i in range(50)]), public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "x"))
    files = [p for p in (tmp_path / "x").iterdir() if p.suffix == ".orc"]
    assert sum(orc.ORCFile(p).nrows for p in files) == 50
    plan = read_token_ids(spark, str(tmp_path / "x")).where("doc_id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,7)" in plan


def test_pieces_over_two_lines_are_not_kept():
    """They hardly ever come again, and would crowd out words that do."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = PieceIds(path, most=100)
    for i in range(300):
        text = f"it was there.\nLine{i}a begins on x{i}b\ny"
        assert np.frombuffer(pieces.of_text(text), "<u4").tolist() == pieces.tokenizer.encode(text, add_special_tokens=False).ids
    assert {"was", "begins", "on"} <= set(pieces) and not any("\n" in p for p in pieces)


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(rows, items, window):
    out = []
    for i, t in rows:
        w, hit, found = words_of(t), set(), set()
        for name, text in items:
            iw = words_of(text)
            k = min(window, len(iw))
            for a in range(len(iw) - k + 1 if k else 0):
                for b in range(len(w) - k + 1):
                    if w[b : b + k] == iw[a : a + k]:
                        hit |= set(range(b, b + k))
                        found.add(str(name))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block_words", [2_000_000, 4])
def test_decontamination_against_brute_force(spark, seed, block_words):
    rng = random.Random(seed)

    def make(n):
        return "".join(rng.choice(["a", "b", "É", "c9", "Dd"]) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))

    items = [(i, make(rng.randint(0, 9))) for i in range(6)] + [(3, make(4)), (7, None), (None, "a b")]
    rows = [*ODD[:7], *enumerate([make(rng.randint(0, 40)) for _ in range(20)], 100)]
    found = contamination(documents(spark, rows, extra=True), spark.createDataFrame(items, "item_id int, text string"), window=4, block_words=block_words)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in found.collect()), key=str)
    assert got == brute_hits(rows, [x for x in items if x[0] is not None], 4)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in found.collect())


def test_decontamination_rule_and_empty_tables(spark):
    no_items = spark.createDataFrame([], "item_id int, text string")
    found = contamination(documents(spark, ODD), no_items, with_row=True)
    assert found.where(is_contaminated()).count() == 0 and found.count() == len(ODD)
    assert found.select("row.*").columns == documents(spark, []).columns
    assert contamination(documents(spark, []), no_items).count() == 0


def test_long_repeats_are_found(spark):
    text = " ".join(["x y z"] * 3000)
    counts, spans, items = find_spans([text.encode(), b"x y"], Phrases.of([("i", b"x y z x y z")], 4))
    assert counts == [9000, 2] and spans == [[(0, 9000)], []] and items == [["i"], []]


def plain_mix(rows, most=3, weights=(1, 2, 3)):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows}
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in names}
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(total.values()))
    while free:
        over = {s for s in free if most * total[s] <= left / sum(w[x] for x in free) * w[s]}
        if not over:
            target |= {s: left / sum(w[x] for x in free) * w[s] for s in free}
            break
        s = min(over, key=lambda s: most * total[s] / w[s])
        target[s] = float(most * total[s])
        left -= target[s]
        free.remove(s)
    return size, total, target


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 20, 60])), "en", rng.choice(["a", "a", "a", "b", "c", None, ""])) for i in range(3000)]
    rows.append((3000, None, "en", "tiny"))
    docs = documents(spark, rows, extra=True)
    found = mix(docs).collect()
    size, total, target = plain_mix(rows)
    source = {r[0]: r[3] for r in rows}
    assert len(found) == len(rows)
    taken = {}
    for r in found:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[source[r["doc_id"]]] = taken.get(source[r["doc_id"]], 0) + r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 61
    assert sum(taken.values()) <= sum(size.values())
    assert sorted(map(tuple, mix(docs.repartition(7)).collect())) == sorted(map(tuple, found))
    copies = mixed_documents(docs)
    assert copies.columns == docs.columns
    assert copies.count() == sum(r["taken"] // r["size"] for r in found if r["size"])


def test_mixing_odd_rows(spark):
    assert mix(documents(spark, [])).count() == 0
    assert mix(documents(spark, [(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0
    assert mix(documents(spark, ODD)).count() == len(ODD)
    assert mixed_documents(documents(spark, [])).count() == 0
    assert {r["taken"] for r in mix(documents(spark, [(1, "a b", "en", "x")]), MixSettings(weights=(5,))).collect()} == {2}


def plain_shards(rows, limit):
    bits = {i: bin(int(hashlib.md5(str(i).encode()).hexdigest()[:16], 16))[2:].zfill(64) for i, _ in rows}
    out = {}
    for i, t in rows:
        for depth in range(65):
            group = [j for j, _ in rows if bits[j][:depth] == bits[i][:depth]]
            held = sum(len((u or "").encode()) for j, u in rows if bits[j][:depth] == bits[i][:depth])
            if held <= limit or len(group) == 1:
                out[i] = (i, len((t or "").encode()), bits[i][:depth], depth, held)
                break
    return sorted(out.values())


@pytest.mark.parametrize("settings", [ShardSettings(limit_bytes=200), ShardSettings(limit_bytes=200, spare_bits=0, most_bits=2)])
def test_sharding(spark, settings):
    rng = random.Random(9)
    rows = [(i, "x" * rng.choice([0, 10, 60, 300])) for i in range(120)] + [(500, None)]
    assert sorted(map(tuple, shards(documents(spark, rows, extra=True), settings).collect())) == plain_shards(rows, 200)


def test_sharding_odd_rows(spark, tmp_path):
    assert shards(documents(spark, [])).count() == 0
    rows = [(1, "x" * 50)] * 40 + [(None, "x" * 50)] * 3
    found = shards(documents(spark, rows), ShardSettings(limit_bytes=120)).collect()
    held = {}
    for r in found:
        held[r["shard"]] = held.get(r["shard"], 0) + r["n_bytes"]
    assert len(found) == 43 and all(v <= 120 for v in held.values())
    assert all(held[r["shard"]] == r["shard_bytes"] for r in found)
    write_shards(documents(spark, [(i, "abc") for i in range(20)]), str(tmp_path / "s"), ShardSettings(limit_bytes=12))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 20


def test_mixed_documents_take_what_the_mix_decides(spark):
    """Repeated and null ids, rows of one id in two sources, and columns named as the operator's."""
    rng = random.Random(11)
    rows = [(rng.choice([None, 1, 2, 3, i]), "w " * rng.randint(1, 30), "en", rng.choice(["a", "b", "c", None])) for i in range(200)]
    docs = documents(spark, rows, extra=True)
    for name in ("mixed_copies", "mixed_copy", "number", "copies", "row", "tie", "apart"):
        docs = docs.withColumn(name, F.lit("mine"))
    taken = {(r[0], r[1]): r[2] for r in mix(docs).groupBy("doc_id", "source_size").agg(F.sum("taken")).collect()}
    copies = mixed_documents(docs)
    assert copies.columns == docs.columns
    found = copies.select("doc_id", F.size(F.split(F.trim("text"), " ")).alias("words"), "number").collect()
    assert sum(r["words"] for r in found) == sum(taken.values()) <= sum(len(t.split()) for _, t, *_ in rows)
    assert {r["number"] for r in found} == {"mine"}


def test_mixing_spreads_a_repeated_id(spark, monkeypatch):
    import vertexloom.llm.mixing as mixing

    rows = [(7 if i % 2 else i, "w " * (i % 13 + 1), "en", "ab"[i % 3 == 0]) for i in range(600)]
    want = mix(documents(spark, rows)).agg(F.sum("taken"), F.count("*")).first()
    monkeypatch.setattr(mixing, "ROWS_IN_RANGE", 16)
    found = mix(documents(spark, rows)).agg(F.sum("taken"), F.count("*")).first()
    assert abs(found[0] - want[0]) <= 13 and found[1] == want[1] == 600


def test_shards_are_written_row_by_row(spark, tmp_path):
    docs = documents(spark, [(1, "x" * 50)] * 10 + [(None, "x" * 50)] * 3 + ODD, extra=True).withColumn("shard_column", F.lit(1)).withColumn("number", F.lit(2))
    write_shards(docs, str(tmp_path / "s"), ShardSettings(limit_bytes=120))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 13 + len(ODD)
    assert set(back.columns) == (set(docs.columns) - {"shard"}) | {"shard", "shard_column_"}
    sizes = back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows"))
    assert sizes.where("bytes > 120 AND rows > 1").count() == 0


def test_scratch_folder_is_shared_off_local(spark):
    from types import SimpleNamespace

    from vertexloom.llm.common import scratch_dir

    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", applicationId="a")))
    assert scratch_dir(spark)
