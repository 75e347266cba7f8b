"""The registered queries against plain versions of what they must return, over the whole smallest tables."""

import base64
import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import tokenizers
import xxhash

from lectern.llm import ann, langid, packing, queries, substring, toxicity, webp

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in queries.table(spark, SF, "documents").collect()}


def test_op1_targets_and_sizes(spark, docs):
    rows = queries.op1_mixing(spark, SF).collect()
    assert {r.doc_id for r in rows} == docs.keys() and len(rows) == len(docs)
    size = {d: len(WORD.findall(r.text or "")) for d, r in docs.items()}
    total = {}
    for d, r in docs.items():
        total[r.source] = total.get(r.source, 0) + size[d]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    target, open_, left = {}, set(total), 1.5 * sum(total.values())
    while open_:  # stop what is above its cap, share the rest again
        level = left / sum(weight[s] for s in open_)
        capped = {s for s in open_ if level * weight[s] >= 2 * total[s]}
        if not capped:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in capped}
        left -= sum(2 * total[s] for s in capped)
        open_ -= capped
    taken = dict.fromkeys(total, 0)
    for r in rows:
        s = docs[r.doc_id].source
        assert r["size"] == size[r.doc_id] and r.source_size == total[s] and math.isclose(r.target, target[s], rel_tol=1e-9) and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    largest = {s: max(size[d] for d, r in docs.items() if r.source == s) for s in total}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in total)


def test_op2_pieces(spark, docs):
    tok = tokenizers.Tokenizer.from_file(queries.tokenizer())
    ids = {d: [*tok.encode(r.text or "", add_special_tokens=False).ids, 1] for d, r in docs.items()}
    rows = queries.op2_packing(spark, SF).collect()
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes())
    for parts, most in [*((p, len(ids[d])) for d, p in by.items()), *((p, None) for p in sequences.values())]:
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
        assert at == most if most is not None else at <= 2048
    assert by.keys() == docs.keys()


@pytest.mark.parametrize("sources,window,lane,least", [(400, 16, 1024, 4), (10_000, 64, 1 << 14, 16)])
def test_packing_with_more_sources_than_a_lane_holds(spark, sources, window, lane, least):
    draw = random.Random(sources)
    rows = [(i, " ".join(draw.choice("abcdefgh") * draw.randint(1, 4) for _ in range(draw.randint(1, 12))), f"s{i}") for i in range(sources)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), queries.tokenizer(), window, 1, None, least, lane).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset").collect()
    by = {}
    for r in got:
        by.setdefault(("doc", r.doc_id), []).append((r.start, r.length))
        by.setdefault(("window", r.sequence_id), []).append((r.offset, r.length))
    whole = {r.doc_id: r.doc_tokens for r in got}
    for (kind, name), parts in by.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == whole[name] if kind == "doc" else at <= window
    assert len(whole) == sources


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op3_fingerprints_and_components(spark, docs):
    rows = queries.op3_simhash(spark, SF).collect()
    prints = {d: fingerprint(r.text) for d, r in docs.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{p:016x}" for d, p in prints.items()}
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in docs:
        for b in docs:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id: r.component_id for r in rows} == {d: find(d) for d in docs}


def test_op4_rows_read_back(spark, docs):
    tok = tokenizers.Tokenizer.from_file(queries.tokenizer())
    got = {}
    for r in queries.op4_token_output(spark, SF).collect():
        ids, at = np.zeros(2048, "<u4"), np.zeros(2048, "<u4")
        at[r.n_tokens:] = np.arange(2048 - r.n_tokens)
        for doc, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            whole = [*tok.encode(docs[doc].text or "", add_special_tokens=False).ids, 1]
            ids[a:b], at[a:b] = whole[start:start + b - a], np.arange(b - a)
            got.setdefault(doc, []).append((start, b - a, len(whole)))
        assert r.ids_crc32 == zlib.crc32(ids.tobytes()) and r.positions_crc32 == zlib.crc32(at.tobytes())
    assert got.keys() == docs.keys() and all(sum(n for _, n, _ in p) == p[0][2] for p in got.values())


def test_op5_equals_plain_out_of_place(spark, docs):
    rows = {r.doc_id: r for r in queries.op5_language_id(spark, SF).collect()}
    table = queries.table(spark, SF, "documents")
    profiles = langid.learn(table.where(~langid.held_out()))
    ranked = {name: {int(c): int(r) for c, r in zip(profiles.codes, profiles.ranks[:, k]) if r >= 0} for k, name in enumerate(profiles.names)}
    for d, r in docs.items():
        said = " ".join("".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (r.text or "").lower()).split())
        got = rows[d]
        assert got.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        if not said:
            assert (got.lang_pred, got.score) == ("und", 0.0)
            continue
        said = f" {said} "
        counts = Counter(g for n in (1, 2, 3) for i in range(len(said) - n + 1) if (g := said[i:i + n]) != " ")
        code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
        mine = [code(g) for g in sorted(counts, key=lambda g: (-counts[g], code(g)))[:langid.PROFILE]]
        distance = {name: sum(min(abs(known[c] - k), langid.PROFILE) if c in known else langid.PROFILE for k, c in enumerate(mine)) for name, known in ranked.items()}
        best = min(sorted(distance), key=distance.__getitem__)
        assert got.lang_pred == best and math.isclose(got.score, 1 - distance[best] / (langid.PROFILE * len(mine)))


def test_op6_swaps_act_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    table, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    rows = queries.op6_toxicity(spark, sf).collect()
    assert len(rows) == table.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    said = table.join(labels, "doc_id").where("text is not null and toxic is not null").select("doc_id", "text", "toxic").collect()
    train, test = ([(r.text, r.toxic) for r in said if (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == held] for held in (False, True))
    plain, fair = (toxicity.fit([t for t, _ in train], [y for _, y in train], counterfactual=c) for c in (0.0, 1.0))
    learned = toxicity.learn(table.where(~langid.held_out()), labels)
    assert fair.swapped > 100 and learned.swapped == fair.swapped

    def gap(model):
        pairs = [p for t, _ in test for p in toxicity.text_changes(t)]
        return np.mean([abs(sum(model.weights.get(f, 0) for f in b) - sum(model.weights.get(f, 0) for f in a)) for a, b in pairs])

    def auc(model):
        good, bad = ([model.margin(toxicity.words(t)) for t, y in test if y == k] for k in (0, 1))
        return np.mean([(b > g) + (b == g) / 2 for b in bad for g in good])

    assert gap(fair) < 0.1 * gap(plain) and auc(fair) > auc(plain) - 0.02 and auc(fair) > 0.9
    # every score again, from the learned weights alone
    said = {r.doc_id: r.text for r in table.collect()}
    for r in rows:
        found = set(re.findall(r"[^\W\d_]+", (said[r.doc_id] or "").lower()))
        marks = {w for w in found} | {w[:5] + "*" for w in found if len(w) > 5} | {w[:7] + "*" for w in found if len(w) > 7}
        z = learned.bias + sum(w for f, w in learned.weights.items() if f in marks)
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_op6_swaps_stay_inside_sentences():
    changed = toxicity.text_changes("He came. She went home! The idiot and he\nran; der Hund, la casa")
    kinds = Counter({(g, c): n for (g, c), n in changed.items()})
    assert kinds == {(("he",), ("she",)): 2, (("she",), ("he",)): 1}  # no articles, and "she" elsewhere does not hide "he"
    assert toxicity.text_changes("he and she") == {(("he",), ()): 1, (("she",), ()): 1} and not toxicity.text_changes(None) and not toxicity.text_changes("...")


def test_op6_neutral_mentions_by_default():
    """Texts that name a group are toxic by their company alone; the default penalty takes that from the name."""
    draw = random.Random(5)
    filler = [f"w{i}" for i in range(40)]
    say = lambda *extra: " ".join(draw.sample(filler, 8) + list(extra))
    toxic = [say("idiot", "muslim") for _ in range(80)] + [say("scum") for _ in range(40)]
    clean = [say() for _ in range(150)] + [say("christian") for _ in range(10)]
    plain, fair = (toxicity.fit(toxic + clean, [1] * 120 + [0] * 160, **o) for o in ({"counterfactual": 0.0}, {}))
    neutral, rude = [say("muslim") for _ in range(60)], [say("idiot") for _ in range(60)]
    wrong = lambda m: np.mean([m.score(t) >= 0.5 for t in neutral])
    assert wrong(plain) > 0.5 and wrong(fair) < 0.1 and np.mean([fair.score(t) >= 0.5 for t in rude]) > 0.9


def test_op6_without_terms_warns():
    with pytest.warns(UserWarning, match="identity"):
        toxicity.fit(["bad word", "good word"] * 5, [1, 0] * 5)


def test_op7_digests_and_features_of_the_method(spark, docs):
    media = {}
    for r in queries.op7_webp(spark, SF).collect():
        b = (docs[r.doc_id].text or "").encode()
        payload = b + b" " * (-len(b) % 192 if b else 192)
        file = media.setdefault(payload, webp.encode_samples(payload))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
    heads = [webp._head_of(s) for f in media.values() for s in webp.streams(f)]
    used = sum(h.distance is not None or h.palette is not None for h in heads)
    assert used > 0.8 * len(heads) and sum(map(len, media.values())) < 0.6 * sum(map(len, media))
    assert all((webp.decode_vp8l(s) == i).all() for f in [*media.values()][:4] for s, i in zip(webp.streams(f), webp.decode_many(webp.streams(f))))


def test_published_and_handmade_streams():
    # the one-pixel lossless file by which browsers are tested for the format
    one = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert webp.decode_many(webp.streams(one))[0].tolist() == [[0]]
    bits = [(0x2F, 8), (1, 14), (0, 14), (0, 1), (0, 3), (0, 3)]  # two pixels; no transform, cache or groups
    bits += [(1, 1), (1, 1), (1, 1), (10, 8), (200, 8)]  # green: 10 or 200, a bit each
    bits += [(1, 1), (0, 1), (1, 1), (7, 8), (1, 1), (0, 1), (1, 1), (9, 8), (1, 1), (0, 1), (1, 1), (255, 8), (1, 1), (0, 1), (0, 1), (0, 1)]
    bits += [(1, 1), (0, 1)]
    word = at = 0
    for v, n in bits:
        word, at = word | v << at, at + n
    stream = word.to_bytes(-(-at // 8), "little")
    for image in (webp.decode_vp8l(stream), webp.decode_many([stream])[0]):
        assert image.tolist() == [[0xFF07C809, 0xFF070A09]]


def test_pixels_are_the_images(spark):
    from lectern.llm import media

    image = np.array([[0xFF102030, 0x80405060, 0xFF102030]], np.uint32)
    rows = spark.createDataFrame([(bytearray(webp.riff(webp.encode_vp8l(image, (webp.PREDICTOR, webp.SUBTRACT_GREEN), cache_bits=3))),), (None,)], "m binary")
    got = [r[0] for r in rows.select(media.pixels("m")).collect()]
    assert got[1] == [] and (got[0][0].width, got[0][0].height) == (3, 1) and bytes(got[0][0].pixels) == image.astype("<u4").tobytes()


def test_op8_removes_only_what_stood_before(spark, docs):
    """All runs: what goes stands in an earlier document or earlier in the text, and every passage of 51 words that does so
    loses words."""
    rows = {r.doc_id: r for r in queries.op8_substring(spark, SF).collect()}
    assert rows.keys() == docs.keys()
    split = {d: [(m.group().lower(), *m.span()) for m in WORD.finditer(r.text or "")] for d, r in docs.items()}
    first: dict[str, tuple[int, int]] = {}
    for d in sorted(docs):
        for i in range(len(split[d]) - 19):
            first.setdefault(" ".join(w for w, _, _ in split[d][i:i + 20]), (d, i))
    gone = 0
    for d, r in docs.items():
        stood = set()  # places of words in 20 that stood before
        for i in range(len(split[d]) - 19):
            if first[" ".join(w for w, _, _ in split[d][i:i + 20])] < (d, i):
                stood.update(range(i, i + 20))
        for s in rows[d].spans or []:
            inside = [k for k, (_, a, b) in enumerate(split[d]) if a >= s.start and b <= s.stop]
            assert len(inside) >= 25 and stood.issuperset(inside), (d, s)
            gone += len(inside)
    assert gone > 1000
    split = {d: (r.text or "").lower().split() for d, r in docs.items()}
    passage: dict[str, int] = {}
    for d in sorted(docs):
        left = set(" ".join(rows[d].text.lower().split()[i:i + 51]) for i in range(len((rows[d].text or "").split()) - 50))
        assert not any(p in passage and passage[p] < d for p in left), d
        for i in range(len(split[d]) - 50):
            passage.setdefault(" ".join(split[d][i:i + 51]), d)


def test_op8_rows_without_id_and_clashing_columns(spark):
    import corpus_pipeline

    draw = random.Random(2)
    line = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    shared = line(60)
    data = [(None, f"{line(20)}. {shared}. {line(3)}", 7, "x"), (None, f"{line(30)}. {shared}. {line(5)}", 7, "x"), (None, shared, 7, "x"), (None, shared, 7, "x"), (2**63 - 1, line(70), 1, "y"), (None, None, 1, ""), (3, "", 1, "")]
    df = spark.createDataFrame(data, "doc_id long, text string, removed int, spans string")
    texts = [r.text or "" for r in substring.dedup_substrings(df).collect()]
    assert sum(shared in t for t in texts) == 1 and len(texts) == len(data)
    kept = corpus_pipeline.drop_repeated_passages(spark, df, "").collect()
    assert kept[0].__fields__ == df.columns and sum(shared in (r.text or "") for r in kept) == 1 and {r.removed for r in kept} == {7, 1}


def test_op9_slots(spark, docs):
    rows = queries.op9_sharding(spark, SF).collect()
    by = {}
    for r in rows:
        b = (docs[r.doc_id].text or "").encode()
        assert r["size"] == len(b) + 8 and r.text_crc32 == zlib.crc32(b) and r.law == "key" and r.grown_shard in (r.shard, 24)
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values()) and len(rows) == len(docs)


def test_op10_where_a_query_sees_few_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 300)
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(150, 24))
    x = (centres[draw.integers(0, 150, 8000)] + 0.25 * draw.normal(size=(8000, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").cache()
    rows = df.selectExpr("vec_id", "cast(embedding as array<double>) as vector")
    index = ann.build(rows, 5)[1]
    assert 6 <= index.budget < 0.2 * 8000
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    want, got = {}, {}
    for q in range(0, 8000, 50):
        s = y @ y[q]
        s[q] = -9
        want[q] = np.lexsort((np.arange(8000), -s))[:5].tolist()
    for exact in (False, True):
        found = ann.nearest(df, recall=1.0 if exact else ann.RECALL).collect()
        got = {}
        for r in found:
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
            assert math.isclose(r.score, y[r.query_id] @ y[r.vec_id], rel_tol=1e-9)
        hits = sum(len(set(want[q]) & {v for _, v in got[q]}) for q in want)
        assert all(sorted(k for k, _ in v) == [1, 2, 3, 4, 5] for v in got.values()) and got.keys() == want.keys()
        assert hits == 5 * len(want) if exact else hits >= 0.9 * 5 * len(want)


def test_language_sample_is_bounded_for_repeated_texts(spark):
    rows = [(i, "der hund und die katze", "de") for i in range(3000)] + [(5000 + i, f"the dog and cat {i}", "en") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.learn(df, most=50).names) == {"de", "en"}
    assert {r.lang_pred for r in langid.identify(df, most=50).where("doc_id < 3000").collect()} == {"de"}


def test_pipeline_against_plain_stages(spark, tmp_path):
    """Exact and near copies, a shared passage, text in no language, and clean documents, through all stages."""
    import corpus_pipeline

    draw = random.Random(8)
    vocabulary = {"en": "the and of to with that was for not are but from they have this which".split(), "de": "der die und das nicht mit sich auf ein ist dem von zu den auch als".split()}
    word = lambda lang: "".join(draw.choice("abdeghilmnorstu") for _ in range(draw.randint(3, 9))) if draw.random() < 0.5 else draw.choice(vocabulary[lang])
    text = lambda lang, n: " ".join(word(lang) + ("." if draw.random() < 0.08 else "") for _ in range(n))
    clean = [(i, text(lang := ("en", "de")[i % 2], 120), lang, f"s{i % 4}") for i in range(40)]
    shared = text("en", 70)
    exact = [(100 + i, clean[i][1], clean[i][2], "s0") for i in range(6)]
    near = [(200 + i, clean[i][1] + " end of it", clean[i][2], "s1") for i in range(10, 16)]
    passages = [(300 + i, f"{text('en', 80)} {shared} {text('en', 30)}", "en", "s2") for i in range(4)]
    odd = [(400, "12 34 !!", "en", "s0"), (401, None, "en", "s0"), (402, "", None, None)]
    rows = clean + exact + near + passages + odd
    path = tmp_path / "sf"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, str(path)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r.doc_id: r for r in docs.collect()})
    ids = lambda part: {r[0] for r in part}
    assert kept[0].keys() == ids(clean + exact + near + passages)
    assert kept[1].keys() == ids(clean + passages)
    assert kept[2].keys() == ids(clean + passages) and all(kept[2][r[0]].text == r[1] and kept[2][r[0]].n_chars == len(r[1]) for r in clean)
    assert [shared in kept[2][300 + i].text for i in range(4)] == [True, False, False, False]
    assert kept[3].keys() <= kept[2].keys()
    size = lambda t: len(WORD.findall(t))
    mixed = sum(size(r.text) for r in docs.collect())
    assert abs(mixed - 1.5 * sum(size(r.text) for r in kept[2].values())) < 4 * 250
    tok = tokenizers.Tokenizer.from_file(queries.tokenizer())
    wanted = sum(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r.length for r in corpus_pipeline.run(spark, str(path)).collect()) == wanted


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df, found = queries.QUERIES[name](spark, SF), con.execute(sql)
        assert sorted(map(tuple, df.select(*[d[0] for d in found.description]).collect())) == sorted(found.fetchall())


def test_lockstep_reads_two_literals_a_step():
    """Codes of two bits fit twice in the table's bits; those of SPAN bits stand alone, and copies are no literals."""
    lengths = [0] * 280
    lengths[7] = lengths[9] = lengths[11] = lengths[260] = 2
    entry = webp._paired(webp._table(lengths))
    count, bits = entry >> 16 & 3, entry >> 18
    assert sorted({*zip(count.tolist(), bits.tolist())}) == [(0, 2), (1, 2), (2, 4)]
    assert {int(e) & 255 for e in entry[count == 0]} == {4}
    assert {(int(e) & 255, int(e) >> 8 & 255) for e in entry[count == 2]} == {(a, b) for a in (7, 9, 11) for b in (7, 9, 11)}


def test_webp_images_encoded_together_equal_those_encoded_alone(monkeypatch):
    """Payloads of any length, also over several images, with and without palettes and copies, flattened codes and long runs."""
    rng, steps, find = random.Random(4), [], webp.find_copies
    monkeypatch.setattr(webp, "find_copies", lambda data, *at: steps.append(len(data)) or find(data, *at))
    many = []
    for letters in (b" ", b"ab", b"abc", bytes(range(60, 77)), bytes(range(256))):
        words = [bytes(rng.choices(letters, k=rng.randrange(1, 80))) for _ in range(20)]
        many += [b"".join(rng.choice(words) * rng.choice([1, 1, 30]) for _ in range(rng.choice([1, 9, 60]))) for _ in range(40)]
    skewed = [1, 1]
    while sum(skewed) < 11_000:
        skewed.append(skewed[-1] + skewed[-2])
    many += [b"", b"a" * 60_000, bytes(rng.sample(range(256), 256)) + bytes(rng.sample([i for i, n in enumerate(skewed) for _ in range(n)], sum(skewed)))]
    payloads = [p + b" " * (-len(p) % webp.WIDTH) if p else b" " * webp.WIDTH for p in many]
    files = [*webp.encode_many(payloads)]
    assert len(files) == len(payloads) and len(steps) <= sum(map(len, payloads)) // webp.TOGETHER + 1 < len(payloads) / 2  # one for each image before
    assert [webp.encode_samples(p) for p in payloads] == files and [*webp.encode_many([])] == [] and [*webp.encode_many([b""])] == [b""]
    for p, f in zip(payloads, files):
        assert b"".join((i >> np.uint32(8)).astype("u1").tobytes() for i in webp.decode_many(webp.streams(f))) == p
    first = webp.streams(files[-1])[0]
    assert (webp.decode_vp8l(first) == webp.decode_many([first])[0]).all()
