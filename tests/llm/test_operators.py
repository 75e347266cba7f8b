"""The operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import ann, langid, media, mixing, packing, queries, sharding, simhash, substring, token_output, toxicity, webp
from lectern.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, shard int, score double, key string, cls string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return queries.table(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and columns with names of our own."""
    long = " ".join(f"word{i % 977} the." for i in range(30_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "   \n ", "en", None), (4, long, "en", "a"), (4, long, "en", "a"), (None, "hello there world", None, "b"), (5, "hello there world", "de", "b"), (6, "1234 !!", "de", "~")]
    return spark.createDataFrame([(*r, 1, 0.5, "k", "c", 0) for r in rows], ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


def python_jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_function(spark):
    keys = [1, 42, 0xDEAD10CC, 256, -5, 2**63 - 1, -(2**63), 0]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 24, 57):
        got = dict(df.select("k", sharding.jump_shard(F.col("k"), n).alias("s")).collect())
        assert got == {k: python_jump(k, n) for k in keys}


def test_sharding(docs, odd, empty):
    for table in (docs, odd):
        rows = sharding.shard(table, 24).collect()
        assert len(rows) == table.count()
        by = {}
        for r in rows:
            by.setdefault(r.shard, []).append(r.slot)
            assert r.grown_shard in (r.shard, 24)
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard(empty, 24).count() == 0


def test_mixing_meets_targets(docs, odd, empty):
    rows = mixing.mix(docs).collect()
    src = dict(docs.select("doc_id", "source").collect())
    size, taken, target, largest = {}, {}, {}, {}
    for r in rows:
        s = src[r.doc_id]
        size[s], taken[s], target[s] = size.get(s, 0) + r["size"], taken.get(s, 0) + r.taken, r.target
        largest[s] = max(largest.get(s, 0), r["size"])
        assert r.taken in (0, r["size"], 2 * r["size"])
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    for s in size:
        assert target[s] <= 2 * size[s] + 1e-6 and target[s] - largest[s] < taken[s] <= target[s] + 1e-6  # less than a document is missing
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    level = {round(target[s] / weight[s], 6) for s in size if target[s] < 2 * size[s] - 1e-6}
    assert len(level) <= 1
    assert sorted(rows) == sorted(mixing.mix(docs).collect())
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mixed_documents(empty).count() == 0


def test_encoder_equals_the_tokenizer(docs):
    enc = Encoder(queries.tokenizer(), most=50)
    texts = [r.text for r in docs.limit(40).collect()] + ["", " ", "a  b", "a \n b", "x\n \ny ", " lead", "tail ", "<|endoftext|> x", "é  ö\x1cz", "it's 12,5%\t\tq", "\x00 a"]
    for t in texts:
        assert np.frombuffer(enc.ids(t), "<u2").tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def check_pieces(rows, whole, window):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.ids))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, pieces in by_doc.items():
        got, at = b"", 0
        for start, length, ids in sorted(pieces):
            assert start == at and len(ids) == 4 * length
            got, at = got + bytes(ids), at + length
        assert np.frombuffer(got, "<u4").tolist() == whole[doc]
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return by_seq


@pytest.mark.parametrize("weights", [None, {"src0": 3.0, "src1": 1.0, "*": 2.0}])
def test_packing_is_lossless_and_full(docs, weights):
    enc = Encoder(queries.tokenizer())
    whole = {r.doc_id: [*np.frombuffer(enc.ids(r.text), "<u2").tolist(), 1] for r in docs.collect()}
    rows = packing.pack(docs, queries.tokenizer(), 256, 1, weights, 16, lane=1 << 14).collect()
    by_seq = check_pieces(rows, whole, 256)
    assert {r.doc_id for r in rows} == whole.keys()
    assert sum(sum(n for _, n in p) for p in by_seq.values()) > 0.95 * 256 * len(by_seq)
    if weights is None:  # windows in a row hold the sources in the proportions of the table
        total, share = sum(map(len, whole.values())), {}
        for r in rows:
            share.setdefault(r.sequence_id // 20, {}).setdefault(r.cls, []).append(r.length)
        for source in {r.cls for r in rows}:
            of = sum(r.length for r in rows if r.cls == source) / total
            for span in list(share.values())[:3]:
                assert abs(sum(span.get(source, [])) / sum(map(sum, span.values())) - of) < 0.02


def test_packing_edges(odd, empty):
    rows = packing.pack(odd, queries.tokenizer(), 128).collect()
    assert sum(r.length for r in rows if r.doc_id in (1, 2)) == 2
    assert packing.pack(empty, queries.tokenizer()).count() == 0


def test_matrix_rows(docs, odd, empty):
    enc = Encoder(queries.tokenizer())
    for table in (docs, odd):
        got = {}
        for r in token_output.pack_matrix(table, queries.tokenizer(), 256, lane=1 << 13).collect():
            ids, at = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
            assert len(ids) == len(at) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
            for doc, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
                assert at[a:b].tolist() == list(range(b - a))
                got.setdefault(doc, []).append((start, ids[a:b].tolist()))
        for r in table.where("doc_id is not null").dropDuplicates(["doc_id"]).collect():
            mine = [x for _, part in sorted(got[r.doc_id]) for x in part]
            copies = table.where(F.col("doc_id") == r.doc_id).count()
            whole = [*np.frombuffer(enc.ids(r.text), "<u2").tolist(), 1]
            assert sorted(mine) == sorted(whole * copies) and (copies > 1 or mine == whole)
    assert token_output.pack_matrix(empty, queries.tokenizer()).count() == 0


def test_best_fit_equals_a_scan():
    draw = random.Random(1)
    lengths = [draw.randint(1, 100) for _ in range(500)]
    room, want = [], []
    for i in sorted(range(500), key=lambda i: (-lengths[i], i)):
        fit = [b for b in range(len(room)) if room[b] >= lengths[i]]
        if fit:
            least = min(room[b] for b in fit)
            room[next(b for b in fit if room[b] == least)] -= lengths[i]
        else:
            room.append(100 - lengths[i])
            want.append(i)
    got = token_output.best_fit(lengths, 100)
    assert sorted(i for b in got for i in b) == list(range(500)) and max(sum(lengths[i] for i in b) for b in got) <= 100
    assert len(got) == len(room)


def brute_components(prints, ids):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {ids[i]: least[find(i)] for i in range(len(ids))}


def test_simhash_components_equal_brute_force(docs, odd, empty):
    rows = simhash.near_duplicates(docs).collect()
    mine = {r.doc_id: simhash.fingerprint(r.text) for r in docs.collect()}
    assert {r.doc_id: r.fp % 2**64 for r in rows} == mine
    assert {r.doc_id: r.component_id for r in rows} == brute_components([mine[k] for k in sorted(mine)], sorted(mine))
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(odd).collect() if r.doc_id} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_first(odd).columns == odd.columns


def test_keep_first_keeps_one_of_each_group(spark):
    said = "a quiet river runs past the old mill and the boats lie still under its bridge until the morning comes"
    other = "nine grey ships left harbour at dawn with salt and iron for towns along a coast that no map had shown"
    third = "she counted every lamp in that long street twice before the rain had put the last of them out again"
    rows = [(None, said), (None, other), (7, third), (7, third), (7, "x y"), (9, third.upper()), (8, None), (None, "")]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, said), (None, other), (7, third), (7, "x y"), (8, None)], key=repr)


def test_near_links_find_all_planted_links(spark):
    draw = random.Random(3)
    base = [draw.getrandbits(64) for _ in range(60)]
    prints = sorted({b ^ sum({1 << draw.randrange(64) for _ in range(draw.randint(0, 3))}) for b in base for _ in range(40)})
    rows = simhash.cut(spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "fp long"))
    want = brute_components(prints, prints)
    for block_rows in (4096, 8):
        links = simhash.near_links(rows, 3, 5, block_rows).collect()
        root = {p: p for p in prints}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            a, b = a % 2**64, b % 2**64
            assert bin(a ^ b).count("1") <= 3
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
        assert {p: find(p) for p in prints} == want


def test_language_id(docs, odd, empty):
    truth = dict(docs.select("doc_id", "lang").collect())
    rows = [r for r in langid.identify(docs).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.95 * len(rows)
    got = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1, 2, 3, 6)) and got[4].lang_pred in ("en", "de")
    assert langid.identify(empty).count() == 0 and langid.keep_identified(odd).columns == odd.columns


def test_toxicity_and_counterfactuals(docs, odd, empty, spark):
    labels = queries.table(spark, SF, "labels")
    assert toxicity.classify(docs, labels).count() == docs.count()
    rows = toxicity.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.classify(empty, labels.limit(0)).count() == 0
    draw = random.Random(5)
    filler = [f"w{i}" for i in range(40)]
    say = lambda *extra: " ".join(draw.sample(filler, 8) + list(extra))
    toxic = [say("idiot", "muslim") for _ in range(80)] + [say("scum") for _ in range(40)]
    clean = [say() for _ in range(150)] + [say("christian") for _ in range(10)]
    y = [1] * len(toxic) + [0] * len(clean)
    plain, fair = (toxicity.fit(toxic + clean, y, counterfactual=c) for c in (0.0, 50.0))
    neutral = [say("muslim") for _ in range(50)]
    assert np.mean([fair.score(t) for t in neutral]) < np.mean([plain.score(t) for t in neutral])
    assert np.mean([fair.score(say("idiot")) > fair.score(say()) for _ in range(50)]) > 0.95


@pytest.mark.parametrize("options", [{}, {"cache_bits": 4}, {"copies": True}, {"tile_bits": 2}, {"copies": True, "cache_bits": 3, "tile_bits": 3}])
@pytest.mark.parametrize("transforms", [(), (webp.PREDICTOR,), (webp.CROSS_COLOUR,), (webp.SUBTRACT_GREEN,), (webp.PALETTE,), (webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN)])
def test_webp_round_trip(options, transforms):
    draw = np.random.default_rng(7)
    for colours in (2, 3, 13, 200):
        table = draw.integers(0, 2**32, colours, dtype=np.uint32)
        image = np.repeat(table[draw.integers(0, colours, (9, 7))], 2, axis=1)[:, :13]
        assert (webp.decode_vp8l(webp.encode_vp8l(image, transforms, **options)) == image).all()


def test_webp_samples_in_lockstep_equal_one_by_one(docs, odd, empty):
    texts = [r.text for r in docs.limit(30).collect()] + ["", "a" * 192, "ab" * 20_000]
    payloads = [(lambda b: b + b" " * ((192 - len(b) % 192) % 192 if b else 192))(t.encode()) for t in texts] + [bytes(range(256)) * 3]
    for p in payloads:
        streams = webp.streams(webp.encode_samples(p))
        for images in (webp.decode_many(streams), [webp.decode_vp8l(s) for s in streams[:1]]):
            got = b"".join((i >> 8 & 0xFF).astype(np.uint8).tobytes() for i in images)
            assert got == p[:len(got)] and (len(got) == len(p) or len(images) == 1)
    rows = media.stored_texts(odd).select("doc_id", "n_bytes", media.features("media").alias("r")).collect()
    want = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    for r in rows:
        b = want[r.doc_id]
        assert r.n_bytes == len(b) and r.r.payload_bytes % 192 == 0 and r.r.tail_crc32 == zlib.crc32((b + b" " * ((192 - len(b) % 192) % 192 if b else 192))[-16:])
    assert media.stored_texts(empty).count() == 0


def test_substring_dedup(spark, odd, empty):
    draw = random.Random(2)
    line = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    passage = ". ".join(line(9) for _ in range(8)) + "."
    one = line(60)
    rows = [(i, f"{line(30)}.\n{passage}\n{line(20)}.") for i in range(5)] + [(9, f"{line(40)} {one} {line(40)}."), (10, f"{line(33)} {one} {line(7)}."), (11, f"Licensed to all.\n{line(50)}."), (12, f"Licensed to all.\n{line(50)}.")]
    got = {r.doc_id: r for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    assert got[0].text == text[0] and got[9].text == text[9] and got[11].text == text[11] and got[12].text == text[12]
    assert all(passage not in got[i].text and got[i].removed for i in range(1, 5))
    assert one not in got[10].text
    assert all(text[k][s.start:s.stop] not in r.text for k, r in got.items() for s in r.spans)
    kept = {r.doc_id: r.text for r in substring.dedup_substrings(odd).collect()}
    assert kept[1] is None and kept[2] == "" and kept[5] == "hello there world"
    assert substring.dedup_substrings(empty).count() == 0


def test_multi_index_recall(spark, empty):
    vectors = queries.table(spark, SF, "embeddings")
    rows = ann.nearest(vectors).collect()
    ids, x = zip(*vectors.select("vec_id", "embedding").collect())
    ids, x = np.array(ids), np.array(x, float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = {(int(ids[q]), int(j)) for q in np.flatnonzero(ids % 50 == 0) for j in ids[np.lexsort((ids, -np.where(ids == ids[q], -9, x @ x[q])))[:5]]}
    got = {(r.query_id, r.vec_id) for r in rows}
    assert len(got & want) >= 0.9 * len(want) and len(rows) == len(want)


def test_multi_index_edges(spark):
    shape = "vec_id long, embedding array<float>, rank int"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 1.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (None, [1.0, 1.0], 1), (50, [1.0, 0.0], 1), (50, [1.0, 0.0], 1)]
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(spark.createDataFrame(rows, shape)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (0, 4, 3), (50, 1, 0), (50, 2, 1), (50, 3, 2), (50, 4, 3)]
    assert ann.nearest(spark.createDataFrame([], shape)).count() == 0


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF)
        assert rows.columns == docs.columns, name
    known = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in rows.collect()} <= known
    assert corpus_pipeline.run(spark, SF).count() > 0
