"""Each operator on awkward rows against a brute-force version."""

import collections
import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clauseplan.llm import licenses, mixing, partial_match, pieces, quality_model, quality_rules, secret_ledger, shared, simhash, suffix_dedup, telephony
from clauseplan.llm.batches import LETTERS, Words, slices
from clauseplan.llm.queries import QUERIES, piece_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_row(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_slices():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 10, None, "b" * 30, "c", "d" * 9]})
    assert [s.num_rows for s in slices(batch, "t", 12)] == [2, 1, 2]
    words = Words(pa.array(["a bb", None, "", "  ccc\nd", "é"]))
    assert (words.ends - words.starts).tolist() == [1, 2, 3, 1, 2] and words.bounds.tolist() == [0, 2, 2, 2, 4, 5]
    assert len(set(words.hashes().tolist())) == 5


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    label = {x: x for e in edges for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                moved = True
    got = dict(map(tuple, shared.components(spark.createDataFrame(edges, "a long, b long")).select("node", "label").collect()))
    assert got == {n: m for n, m in label.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def brute_removals(rows, length=50):
    first = {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - length + 1):
                if first[b[k : k + length]] < i:
                    gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("common", [0, 4096])
def test_suffix_dedup(edge_docs, edge_rows, empty_docs, monkeypatch, common):
    monkeypatch.setattr(suffix_dedup, "COMMON", common)
    monkeypatch.setattr(suffix_dedup, "COMMON_LEAST", 2)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert by_row(suffix_dedup.deduplicated(edge_docs), *columns) == brute_removals(edge_rows)
    assert suffix_dedup.deduplicated(empty_docs).count() == 0


def test_suffix_dedup_many(spark):
    """A line that all share in different surroundings, at random places."""
    rng = random.Random(1)
    line = "".join(rng.choice("abcdefgh ") for _ in range(90))
    rows = []
    for i in range(60):
        noise = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randint(0, 400))) for _ in range(3)]
        cut = rng.randrange(40)
        rows.append((rng.randrange(50), noise[0] + line + noise[1] + line[cut:] + noise[2]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert by_row(suffix_dedup.deduplicated(docs), *columns) == brute_removals(rows)


def test_progressions():
    rng = random.Random(3)
    for _ in range(300):
        start, group = [], []
        for g in range(rng.randint(0, 4)):
            at = 0
            for _ in range(rng.randint(1, 12)):
                at += rng.choice([1, 1, 1, 2, 2, 50, 51, 70])
                start.append(at)
                group.append(g)
        out, owner = suffix_dedup._progressions(np.array(start, np.int64), np.array(group, np.int64))
        back = [(g, int(p["start"]) + k * int(p["step"])) for p, g in zip(out, owner.tolist(), strict=True) for k in range(p["times"])]
        assert back == list(zip(group, start, strict=True)) and (out["step"] <= 50).all()


@pytest.mark.parametrize("period", [1, 2, 37, 61])
def test_suffix_dedup_periodic_texts(spark, period):
    """A long text of short period, in several parts, beside short ones that share its line; as the smallest id and the largest."""
    rng = random.Random(period)
    unit = "".join(rng.choice("-=xyz") for _ in range(period))
    line = (unit * 100)[:130]
    rows = [(i, f"{rng.random()} head {line} tail {rng.random()} " * rng.randint(1, 3)) for i in range(1, 40)]
    for first in (0, 99):
        big = [(first, (unit * 3_000_000)[: 2_300_000])]
        docs = spark.createDataFrame(rows + big, "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.deduplicated(docs, keep_text=False).collect()}
        windows = {(unit * 100)[k : k + 50] for k in range(period)}
        small = dict(rows)
        if first == 0:  # the long text has every window of the line
            assert got[0][0] == 0
            for i, t in rows:
                want = brute_removals([(0, unit * 200), *[(j, x) for j, x in rows if j <= i]])
                assert (i, *got[i]) in {(w[0], w[2], w[4]) for w in want}
        else:
            assert got[99] == (2_300_000, hashlib.sha256(b"").hexdigest()) if all(any(w in t for t in small.values()) for w in windows) else True
            assert {(i, *v) for i, v in got.items() if i != 99} == {(w[0], w[2], w[4]) for w in brute_removals(rows)}


def test_suffix_dedup_heavy_anchors(edge_docs, edge_rows, monkeypatch, spark):
    """Anchors found heavy only by the task that counts them, and hashes that collide."""
    monkeypatch.setattr(suffix_dedup, "COMMON", 0)
    monkeypatch.setattr(suffix_dedup, "HEAVY", 0)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert by_row(suffix_dedup.deduplicated(edge_docs), *columns) == brute_removals(edge_rows)
    chunk = suffix_dedup.Chunk(pa.array([b"abcdefabcxef"]))
    chunk.hashes = lambda a, b: np.zeros(len(a), np.uint64)  # every string collides with every other
    kind = suffix_dedup._alike(chunk, np.array([0, 6, 3, 9, 0]), np.array([3, 9, 6, 12, 4]))
    assert kind[0] == kind[1] and len(set(kind.tolist())) == 4


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(400):
        text = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 60))] + [0]
        assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


# 2


def test_mixing(spark, edge_docs, empty_docs):
    out = mixing.mixed(edge_docs)
    assert out.count() == edge_docs.count() and out.filter("probability is null or probability > 1 or probability < 0").count() == 0
    assert mixing.mixed(empty_docs).count() == 0 and mixing.sampled(empty_docs).columns == empty_docs.columns
    kept = mixing.sampled(edge_docs)
    want = out.filter("kept").groupBy("doc_id").count()
    assert by_row(kept.groupBy("doc_id").count(), "doc_id", "count") == by_row(want, "doc_id", "count")
    assert kept.select("_text").filter("_text <> 'clash'").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_raking_reaches_targets(spark):
    rows = [(i, "w " * (20 + i % 30), ["en", "de"][i % 3 == 0], ["a", "b", "c"][min(i % 7, 2)]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"a": 0.2, "b": 0.3, "c": 0.5}, "lang": {"en": 0.6, "de": 0.4}}
    frame = mixing.marked(docs, "doc_id", "source", "lang", "text", F.lit("one"))
    cells = mixing.rake(frame, targets, rounds=20).toPandas()
    for margin, shares in targets.items():
        found = cells.groupby(f"_{margin}")._fit.sum() / cells._fit.sum()
        assert all(abs(found[k] - v) < 1e-3 for k, v in shares.items())
    out = mixing.mixed(docs, targets, keep=0.5).toPandas()
    assert abs((out.n_tokens * out.probability).sum() / out.n_tokens.sum() - 0.5) < 1e-3


def test_raking_with_full_cells(spark):
    """Against plain Python, with targets that ask for more of some values than there is; and what margins() reports."""
    rows = [(i, "w " * (5 + i % 40), [None, "en", "de"][i % 3], ["a", "b", "c", "d"][min(i % 11, 3)]) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"a": 0.6, "b": 0.2, "d": 0.2}, "lang": {"en": 0.5, "de": 0.3, None: 0.2}}
    weight = collections.Counter()
    for i, t, lang, source in rows:
        weight[source, lang] += len(t.split())
    total = sum(weight.values())
    fit = {c: 0.75 * w for c, w in weight.items()}
    for _ in range(mixing.ROUNDS):
        for at, margin in enumerate(("source", "lang", None)):
            sums = collections.Counter()
            for c, x in fit.items():
                sums[c[at] if margin else "one"] += x
            for c, x in fit.items():
                key = c[at] if margin else "one"
                share = targets[margin].get(key, 0.0) if margin else 1.0
                fit[c] = min(x * share * 0.75 * total / sums[key] if sums[key] else 0.0, weight[c])
    out = mixing.mixed(docs, targets, by=F.lit("one")).join(docs.select("doc_id", "lang", "source"), "doc_id").collect()
    assert all(r.probability == pytest.approx(fit[r.source, r.lang] / weight[r.source, r.lang], abs=2e-6) for r in out)
    found = {(r.margin, r.value): r for r in mixing.margins(docs, targets, by=F.lit("one")).collect()}
    for source in "abcd":
        own = sum(w for c, w in weight.items() if c[0] == source)
        assert found["source", source].reached == pytest.approx(sum(x for c, x in fit.items() if c[0] == source) / 0.75 / total, abs=1e-9)
        assert found["source", source].target == pytest.approx(targets["source"].get(source, 0.0)) and found["source", source].share == pytest.approx(own / total)
    assert found["source", "a"].reached < 0.2 < found["source", "a"].target


# 3


def brute_fingerprint(text):
    import xxhash

    words = [w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, radius=4):
    group = {f: f for f in fps}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    every = list(fps)
    for i, a in enumerate(every):
        for b in every[:i]:
            if (a ^ b).bit_count() <= radius:
                group[root(a)] = root(b)
    return {f: root(f) for f in every}


@pytest.mark.parametrize(("segments", "most"), [(None, 4096), (3, 0), (2, 4096)])
def test_simhash(edge_docs, edge_rows, empty_docs, segments, most):
    fps = [(i, brute_fingerprint(t)) for i, t in edge_rows]
    root = brute_groups({f for i, f in fps if i is not None})
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted(((i, f"{f:016x}", None if i is None else least[root[f]]) for i, f in fps), key=repr)
    assert by_row(simhash.grouped(edge_docs, segments=segments, most=most), "doc_id", "fingerprint", "component_id") == want
    assert simhash.grouped(empty_docs).count() == 0 and simhash.one_of_each(empty_docs).columns == empty_docs.columns
    stay = simhash.one_of_each(edge_docs)
    assert {r.doc_id for r in stay.select("doc_id").collect()} - {None} == set(least.values())


@pytest.mark.parametrize(("most", "batch"), [(4096, 10000), (3, 10000), (3, 2), (40, 16)])
def test_simhash_links(spark, most, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rng = random.Random(4)
    fps = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(25):
            fps.add(f)
            for b in rng.sample(range(64), rng.randint(1, 6)):
                f ^= 1 << b
    root = brute_groups(fps)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    frame = spark.createDataFrame([(signed[f],) for f in fps], "fp long").repartition(4)
    try:
        label = dict(map(tuple, shared.components(simhash.links(frame, most=most)).select("node", "label").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = collections.defaultdict(set)
    want = collections.defaultdict(set)
    for f in fps:
        got[label.get(signed[f], signed[f])].add(f)
        want[root[f]].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


# 4


def test_telephony_tables():
    assert telephony.MULAW_PCM[[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.ALAW_PCM[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    codes = np.arange(256, dtype=np.uint8)
    back = telephony.to_mulaw(telephony.MULAW_PCM[codes])
    assert (telephony.MULAW_PCM[back] == telephony.MULAW_PCM[codes]).all()


def test_adpcm():
    """Across blocks as within one, and near the samples that were coded."""

    def one(block):
        value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        out = [value]
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(telephony.IMA_STEPS[index])
                move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - move if code & 8 else value + move))
                index = max(0, min(88, index + int(telephony.IMA_CHANGES[code & 7])))
                out.append(value)
        return out

    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (7, 40), dtype=np.uint8)
    assert telephony.ima_decode(blocks).tolist() == [one(b.tolist() if False else bytes(b)) for b in blocks]
    tone = (8000 * np.sin(np.arange(5 * 505) / 9)).astype(np.int16).reshape(5, 505)
    heard = telephony.ima_decode(telephony.ima_encode(tone, 256))
    assert np.abs(heard.astype(int) - tone)[:, 50:].mean() < 400


def test_telephony(spark, edge_docs, edge_rows, empty_docs):
    want = []
    for i, t in edge_rows:
        b = (t or "").encode()
        p = b.ljust(max(192, -(-len(b) // 192) * 192))
        m = telephony.write_wave(p)
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest()))
    got = telephony.carried(edge_docs)
    assert by_row(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256") == sorted(want, key=repr)
    assert got.select("payload_sha256").distinct().count() == got.select("payload_sha256", "feature").distinct().count()
    assert telephony.carried(empty_docs).count() == 0


def test_telephony_features(edge_docs, edge_rows):
    """Peak, level, sign changes and the three ways of hearing, one byte after another."""

    def mulaw(b):
        b = ~b & 255
        size = (((b & 15) * 8 + 132) << (b >> 4 & 7)) - 132
        return -size if b & 128 else size

    def alaw(b):
        b ^= 0x55
        part, level = (b & 15) * 16, b >> 4 & 7
        size = part + 8 if level == 0 else (part + 264) << (level - 1)
        return size if b & 128 else -size

    def ima(block):
        value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        out = [value]
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(telephony.IMA_STEPS[index])
                move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - move if code & 8 else value + move))
                index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
                out.append(value)
        return out

    def little(values):
        return b"".join(v.to_bytes(2, "little", signed=True) for v in values)

    got = {(r.doc_id, r.n_bytes): r for r in telephony.carried(edge_docs).collect()}
    for i, t in edge_rows:
        b = (t or "").encode()
        if len(b) > 4000:
            continue
        p = b.ljust(max(192, -(-len(b) // 192) * 192))
        pcm = [mulaw(x) for x in p]
        peak, level = max(map(abs, pcm)), math.sqrt(sum(x * x for x in pcm) / len(pcm))
        turns = sum((x < 0) != (y < 0) for x, y in zip(pcm, pcm[1:], strict=False))
        heard = [s for k in range(0, len(p), 192) for s in ima(p[k : k + 192])]
        r = got[i, len(b)]
        wide = telephony.doubled(np.array(pcm, np.int16)).astype("<i2").tobytes()
        assert wide[::2 * 2][:1] == little(pcm[:1])[:1] and np.frombuffer(wide, "<i2")[::2].tolist() == pcm
        want = f"peak={peak} rms={level:.3f} crossings={turns} pcm16k={zlib.crc32(wide):08x} alaw={zlib.crc32(little(map(alaw, p))):08x} ima={zlib.crc32(little(heard)):08x}"
        assert r.feature == want
        wave = telephony.write_wave(wide, telephony.PCM, 16000, 2)
        assert r.pcm_bytes == len(wave) == 58 + len(wide) and r.pcm_sha256 == hashlib.sha256(wave).hexdigest()


def test_media_column(spark):
    tone = (9000 * np.sin(np.arange(1600) / 7)).astype(np.int16)
    mu = telephony.write_wave(telephony.to_mulaw(tone).tobytes())
    ima = telephony.write_wave(telephony.ima_encode(tone[:1515].reshape(3, 505), 256).tobytes(), telephony.IMA, 8000, 256)
    rows = [(1, mu), (2, ima), (3, telephony.write_wave(tone.tobytes(), telephony.PCM, 16000, 2)), (4, None), (5, b"no"), (6, mu[:60]), (7, telephony.write_wave(b""))]
    out = {r.k: r for r in telephony.decoded(spark.createDataFrame(rows, "k int, media binary").withColumn("pcm", F.lit(1))).collect()}
    for k, n in ((1, 3200), (2, 3030), (3, 1600)):
        assert len(out[k].pcm) == 2 * n and out[k].problem is None
    assert np.abs(np.frombuffer(out[1].pcm, "<i2")[::2].astype(int) - tone).max() < 500
    assert out[4].pcm is None and out[4].problem is None and out[5].problem and out[6].problem and out[7].pcm == b""
    assert telephony.resampled(tone, 8000, 11025).shape == (2205,)


# 5


def brute_licenses(text):
    """Containment in every window, without MinHash."""
    words = Words(pa.array([text or ""]), LETTERS)
    h, _ = licenses.shingle_hashes(words)
    out = set()
    for size, entries in licenses.Index(licenses.TEMPLATES, 1).by_size.items():
        for name, own, _ in entries:
            for a in range(0, len(h), size):
                if len(np.unique(h[a : a + 2 * size][np.isin(h[a : a + 2 * size], own)])) >= licenses.CONTAINED * len(own):
                    out.add(name)
    return sorted(out)


def test_licenses(spark, edge_docs, edge_rows, empty_docs):
    assert by_row(licenses.scanned(edge_docs), "doc_id", "licenses") == sorted(((i, brute_licenses(t)) for i, t in edge_rows), key=repr)
    assert licenses.scanned(empty_docs).count() == 0
    rng = random.Random(6)
    texts = []
    for k in range(60):
        notice = rng.choice([t for ts in licenses.TEMPLATES.values() for t in ts]).split()
        for _ in range(rng.randint(0, len(notice) // 20)):
            notice[rng.randrange(len(notice))] = "other"
        texts.append(" ".join(f"word{rng.randrange(999)}" for _ in range(rng.randint(0, 80))) + "\n// " + "\n// ".join(" ".join(notice[i : i + 7]) for i in range(0, len(notice), 7)) + " tail" * (k % 5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.scanned(docs)
    assert by_row(got, "doc_id", "licenses") == sorted(((i, brute_licenses(t)) for i, t in enumerate(texts)), key=repr)
    span = got.filter("n_spans > 0").first()
    assert texts[span.doc_id].encode()[span.spans[0].start : span.spans[0].end].decode().strip()


def plain_licenses(text):
    """Names by exact containment in the windows, over tuples of words, sharing no code with the operator."""
    def cleaned(x):
        return "".join(c if ord(c) > 127 or c.isalnum() else " " for c in x.lower()) if x.isascii() else "".join((c.lower() if c.isalnum() else " ") if ord(c) < 128 else c for c in x)

    def runs(x):
        words = [w for w in cleaned(x).split(" ") if w]
        return [tuple(words[k : k + 5]) for k in range(len(words) - 4)]

    every, out = runs(text or ""), set()
    for name, texts in licenses.TEMPLATES.items():
        for template in texts:
            own = set(runs(template))
            size = 1
            while size < len(own):
                size *= 2
            if any(len(own & set(every[a : a + 2 * size])) >= 0.8 * len(own) for a in range(0, len(every), size)):
                out.add(name)
    return sorted(out)


def test_licenses_plainly(spark, edge_docs, edge_rows):
    assert by_row(licenses.scanned(edge_docs), "doc_id", "licenses") == sorted(((i, plain_licenses(t)) for i, t in edge_rows), key=repr)
    rng = random.Random(16)
    rows, where = [], {}
    every = [(n, t) for n, ts in licenses.TEMPLATES.items() for t in ts]
    for k in range(120):
        name, notice = every[k % len(every)]
        words = notice.split()
        for _ in range(rng.choice([0, 0, 1, len(words) // 15, len(words) // 8])):
            words[rng.randrange(len(words))] = "changed"
        before, after = (" ".join(f"word{rng.randrange(999)}" for _ in range(rng.randint(0, 120))) for _ in range(2))
        rows.append((k, before + "\n" + "\n * ".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)) + "\n" + after))
        where[k] = name, len(before.encode()), len(rows[-1][1].encode()) - len(after.encode()), words == notice.split()
    got = licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        assert r.licenses == plain_licenses(rows[r.doc_id][1])
        name, start, end, same = where[r.doc_id]
        if same:  # an unchanged notice: its own span holds it, with full containment
            own = [s for s in r.spans if s.license == name]
            assert any(s.containment == 1.0 and s.start <= start + 2 and s.end >= end - 3 for s in own) or len(rows[r.doc_id][1].split()) < 8


# 6


def brute_base(rows):
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in rows]
    words = [[w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [None] for _, t in rows]
    c = collections.Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for ws, h in zip(words, held, strict=True)]


@pytest.mark.parametrize("part_bytes, groups", [(partial_match.PART_BYTES, partial_match.GROUPS), (5000, 1), (5000, 300)])
def test_partial_match(edge_docs, edge_rows, part_bytes, groups):
    trie = partial_match.Trie()
    base = brute_base(edge_rows)
    for (_, t), (held, *_) in zip(edge_rows, base, strict=True):
        if not held:
            trie.train(t or "")
    known = {t: trie.score(t or "") for _, t in edge_rows}
    want = sorted(((i, b[0], b[1], b[2], b[3], round(b[4], 4), round(known[t], 4)) for (i, t), b in zip(edge_rows, base, strict=True)), key=repr)
    got = partial_match.scores(edge_docs, part_bytes=part_bytes, groups=groups)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in got.collect()), key=repr)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=2e-3)


def test_partial_match_splits_crowded_contexts(spark):
    rng = random.Random(11)
    trie, counts = partial_match.Trie(), collections.Counter()
    for _ in range(60):
        text = "ab" * rng.randint(1, 4) + "".join(rng.choice("abcde") for _ in range(40))
        trie.train(text)
        counts.update(c + bytes([s]) for c, s in trie.events(text))
    other = [c + bytes([s]) for c, s in trie.events("abababzq cab" + "abcde" * 9) if c + bytes([s]) not in counts]
    rows = [(int.from_bytes(e, "big"), n) for e, n in [*counts.items(), *((e, 0) for e in set(other))]]
    frame = spark.createDataFrame(rows, "event long, n long")
    want = {e: math.log10(trie.probability(e.to_bytes(6, "big")[:5], e & 255)) for e, _ in rows}
    assert len(rows) > 1000
    for groups in 1, 100, 10_000:  # none is crowded, some, nearly all
        got = {r.event: r.lp for r in partial_match.event_table(frame, groups=groups).collect()}
        assert got == pytest.approx(want)


def test_partial_match_sums_to_one(empty_docs, edge_docs):
    trie = partial_match.Trie(3)
    for t in ("abcabcabd", "xyz", ""):
        trie.train(t)
    for context in (b"abc", b"\xff\xff\xff", b"qqq", b"bca"):
        assert sum(trie.probability(context, s) for s in range(256)) == pytest.approx(1)
    assert partial_match.scores(empty_docs).count() == 0
    assert partial_match.adaptive_scores(edge_docs.filter("length(text) < 500")).filter("score >= 0").count() == 0


# 7


def brute_secrets(text):
    text = text or ""
    found = []
    assign = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    for rank, (kind, pattern, group, least) in enumerate((("assign", assign, 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(found)


def test_secrets(edge_docs, edge_rows, empty_docs):
    ledger = secret_ledger.scan(edge_docs, secret_ledger.BASE_RULES).cache()
    got = secret_ledger.by_path(edge_docs, ledger, secret_ledger.BASE_RULES).select("doc_id", secret_ledger.spans_text(F.col("spans")).alias("s"))
    assert by_row(got, "doc_id", "s") == sorted(((i, ",".join(f"{k}:{a}:{b}" for a, _, b, k in brute_secrets(t))) for i, t in edge_rows), key=repr)
    assert secret_ledger.by_path(empty_docs, secret_ledger.scan(empty_docs)).count() == 0
    assert ledger.count() == len({t or "" for _, t in edge_rows})


def test_ledger_is_incremental(spark, edge_docs):
    first = secret_ledger.scan(edge_docs.filter("doc_id < 12"), secret_ledger.BASE_RULES).cache()
    second = secret_ledger.scan(edge_docs, secret_ledger.BASE_RULES, first).cache()
    assert first.join(second, "blob").count() == 0
    both = first.unionByName(second).cache()
    assert secret_ledger.scan(edge_docs, secret_ledger.BASE_RULES, both).count() == 0
    newer = (*secret_ledger.BASE_RULES[:2], secret_ledger.Rule("hex", 2, "[0-9a-f]{20,}"))
    third = secret_ledger.scan(edge_docs, newer, both).cache()
    assert {tuple(r.rules) for r in third.collect()} == {("hex@2",)}
    whole = secret_ledger.by_path(edge_docs, secret_ledger.scan(edge_docs), secret_ledger.RULES).count()
    assert whole == edge_docs.count()


def test_findings_of_old_rule_versions_are_not_given_out(spark):
    """A 16-character hex string is a finding of hex@1 and none of hex@2, which asks for 20."""
    docs = spark.createDataFrame([(1, "x deadbeefdeadbeef y"), (2, "0123456789abcdef01234567")], "doc_id long, text string")
    newer = (secret_ledger.Rule("hex", 2, "[0-9a-f]{20,}"),)
    old = secret_ledger.scan(docs, (secret_ledger.HEX,))
    both = old.unionByName(secret_ledger.scan(docs, newer, old)).cache()

    def spans(rules):
        got = secret_ledger.by_path(docs, both, rules)
        return {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in got.collect()}

    assert spans(newer) == {1: [], 2: [("hex", 0, 24)]}
    assert spans((secret_ledger.HEX,)) == {1: [("hex", 2, 18)], 2: [("hex", 0, 24)]}


def test_ledger_in_a_folder(spark, edge_docs, edge_rows, tmp_path):
    """Two scans, the second over more versions and with newer rules, against brute force; a third finds nothing to do."""
    folder = f"{tmp_path}/ledger"
    secret_ledger.updated(edge_docs.filter("doc_id % 2 = 0"), folder, secret_ledger.BASE_RULES[:2])
    ledger = secret_ledger.updated(edge_docs, folder, secret_ledger.BASE_RULES)
    n = ledger.count()
    got = secret_ledger.by_path(edge_docs, ledger, secret_ledger.BASE_RULES).select("doc_id", secret_ledger.spans_text(F.col("spans")).alias("s"))
    assert by_row(got, "doc_id", "s") == sorted(((i, ",".join(f"{k}:{a}:{b}" for a, _, b, k in brute_secrets(t))) for i, t in edge_rows), key=repr)
    pairs = ledger.select("blob", F.explode("rules").alias("rule"))
    assert pairs.count() == pairs.distinct().count() == 3 * len({t or "" for _, t in edge_rows})
    assert secret_ledger.updated(edge_docs, folder, secret_ledger.BASE_RULES).count() == n


def test_registered_ledger_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for r in rows:
        found = brute_secrets(r.text)
        count = collections.Counter(k for *_, k in found)
        want.append((r.doc_id, count["assign"], count["access"], count["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in found).encode()).hexdigest()))
    assert by_row(QUERIES["op7_secret_ledger"](spark, folder), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want, key=repr)


def test_crowded_keys_are_spread(spark):
    left = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(300)], "i long, k long")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 300, 2)] + [(7, "v7")], "r long, v string")
    got = shared.spread_join(left, right, "k", "r", F.col("i"))
    assert by_row(got, "i", "k", "v") == sorted(((i, k, f"v{k}" if k % 2 == 0 or k == 7 else None) for i, k in ((i, 7 if i % 3 else i) for i in range(300))), key=repr)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = shared.spread_join(left, right.hint("merge"), "k", "r", F.col("i")).select("k", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len({r.p for r in parts if r.k == 7}) > 1


def test_redaction(edge_docs, empty_docs):
    out = secret_ledger.redacted(edge_docs, secret_ledger.BASE_RULES)
    assert out.schema == edge_docs.schema or out.columns == edge_docs.columns
    want = []
    for r in edge_docs.collect():
        text, at, parts = r.text or "", 0, []
        spans = brute_secrets(text)
        for a, _, b, _ in spans:
            if a >= at:
                parts += [text[at:a], "[secret]"]
            at = max(at, b)
        new = "".join(parts) + text[at:] if spans else r.text
        want.append((r.doc_id, new, len(new) if spans else r.n_chars, r._text))
    assert by_row(out, "doc_id", "text", "n_chars", "_text") == sorted(want, key=repr)
    assert secret_ledger.redacted(empty_docs).count() == 0


# 8


def test_quality_model(spark, edge_docs, empty_docs):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        words = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 8))) for _ in range(60)]
        rows.append((i, " ".join(w + ("" if good else rng.choice(["###", "!!"])) for w in words)))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (700, None), (0, 5)], "doc_id long, quality int")
    out = quality_model.trained_and_scored(docs, marks).toPandas().set_index("doc_id")
    right = [(out.loc[i].predicted == q) for i, q in labels if out.loc[i].held_out]
    assert len(right) > 100 and np.mean(right) > 0.98
    assert all(out.loc[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in labels)
    again = quality_model.trained_and_scored(docs.repartition(7), marks).toPandas().set_index("doc_id")
    assert np.allclose(again.score.sort_index(), out.score.sort_index())
    assert quality_model.trained_and_scored(edge_docs, marks).filter("score is null or score < 0 or score > 1").count() == 0
    none = quality_model.trained_and_scored(edge_docs, marks.limit(0))
    assert none.filter("score <> 0.5").count() == 0 and none.count() == edge_docs.count()
    assert quality_model.trained_and_scored(empty_docs, marks).count() == 0


def test_dual_descent_against_a_plain_solver():
    """The dual optimum, found by projected gradient steps over the whole matrix, and the ratios counted by hand."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 30, rng.integers(3, 9))) for _ in range(60)]
    signs = np.where(np.array([(r < 12).mean() > 0.4 for r in rows]), 1.0, -1.0)
    scale = quality_model.log_count_ratios(rows, (signs > 0).astype(int), 5)
    for f in (0, 13, 29):
        up = [1 + sum(f in r for r, s in zip(rows, signs, strict=True) if s > 0), 32 + sum(len(r) for r, s in zip(rows, signs, strict=True) if s > 0)]
        down = [1 + sum(f in r for r, s in zip(rows, signs, strict=True) if s < 0), 32 + sum(len(r) for r, s in zip(rows, signs, strict=True) if s < 0)]
        assert scale[f] == pytest.approx(math.log(up[0] / up[1] / (down[0] / down[1])))
    weights, bias = quality_model.dual_descent(rows, scale, signs, passes=500)
    x = np.zeros((60, 33))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.sqrt((scale[r] ** 2).sum()) * np.sqrt(50)
        x[i, 32] = 1
    q = (signs[:, None] * x) @ (signs[:, None] * x).T
    alpha = np.zeros(60)
    for _ in range(200_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, 0.05)
    plain = (alpha * signs) @ x

    def loss(w):
        return 0.5 * w @ w + 0.05 * np.maximum(0, 1 - signs * (x @ w)).sum()

    assert loss(np.append(weights, bias)) == pytest.approx(loss(plain), rel=1e-3)


# 9


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, chars, symbols, dup = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    failed = n < 20 or 100 * len(covered) > 30 * n
    kept = not (failed or 100 * symbols > 10 * n or 100 * dup > 30 * len(lines) or not 2 * n <= chars <= 20 * n)
    return n, chars, symbols, dup, len(covered), failed, kept


def test_quality_rules(edge_docs, edge_rows, empty_docs):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = sorted(((i, *brute_quality(t)) for i, t in edge_rows), key=repr)
    assert by_row(quality_rules.report(edge_docs), "doc_id", *columns) == want
    assert by_row(quality_rules.cascade(edge_docs), "doc_id", "kept") == sorted(((w[0], w[-1]) for w in want), key=repr)
    kept = quality_rules.kept_documents(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == sum(w[-1] for w in want)
    for f in (quality_rules.report, quality_rules.cascade, quality_rules.kept_documents):
        assert f(empty_docs).count() == 0


def test_cascade_order():
    rules = quality_rules.RULES[:3]
    numbers = [{"n": 10, "rejected": 1, "seconds": 1.0}, {"n": 10, "rejected": 5, "seconds": 1.0}, {"n": 10, "rejected": 9, "seconds": 9.0}]
    assert [r.name for r in quality_rules.ordered(rules, numbers)] == [rules[1].name, rules[0].name, rules[2].name]
    assert quality_rules.ordered(rules, [{"n": 0, "rejected": 0, "seconds": 0.0}] * 3) == rules


def test_cascade_is_planned_on_what_is_left():
    """A rule that rejects what an earlier one has already rejected comes last, however good it looks alone."""
    a, b, c = (quality_rules.Rule(n, f) for n, f in (("a", lambda x: "1" in x.text), ("b", lambda x: "1" in x.text or "2" in x.text), ("c", lambda x: "3" in x.text)))
    texts = ["1"] * 5 + ["2"] * 1 + ["3"] * 3 + ["-"]
    seconds = {"a": 1.0, "b": 3.0, "c": 1.0}

    def measure(rule, facts):
        return [rule.rejects(x) for x in facts], seconds[rule.name]

    assert [r.name for r in quality_rules.planned((b, c, a), texts, measure)] == ["a", "c", "b"]
    assert quality_rules.planned((a, b, c), [], measure) == (a, b, c) and quality_rules.planned((a, b, c), ["-"], measure) == (a, b, c)


def test_cascade_sample(spark, edge_docs, empty_docs):
    """Whatever the partitions, the same openings, bounded in rows and characters."""
    few = quality_rules.sample(edge_docs, rows=7, chars=30)
    assert len(few) == 7 and max(map(len, few)) <= 30 and few == quality_rules.sample(edge_docs.repartition(5), rows=7, chars=30)
    assert quality_rules.sample(empty_docs) == []


# 10


needs_model = pytest.mark.skipif(not Path("/opt/tokenizers").exists(), reason="no vocabulary files")


@needs_model
def test_pieces(edge_docs, edge_rows, empty_docs):
    import sentencepiece

    model = piece_model()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    out = pieces.encoded(edge_docs, model)
    assert by_row(out, "doc_id", "ids") == sorted(((i, library.encode(t or "")) for i, t in edge_rows), key=repr)
    assert out.filter("n_differ > 0 or n_tokens <> size(ids)").count() == 0
    back = pieces.decoded(out.select("doc_id", "ids"), model)
    assert by_row(back, "doc_id", "text") == sorted(((i, library.decode(library.encode(t or ""))) for i, t in edge_rows), key=repr)
    assert out.filter("not round_trip").count() == sum("▁" in (t or "") for _, t in edge_rows)
    assert pieces.encoded(empty_docs, model).count() == 0


@needs_model
def test_pieces_backend(edge_texts):
    import sentencepiece

    model = piece_model()
    library, core = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Model.parse(model).backend()
    for t in edge_texts:
        if t and len(t) < 5000:
            assert core.encode(t, add_special_tokens=False).ids == library.encode(t)
            if "▁" not in t:
                assert core.decode(library.encode(t)) == t


def hand_made(trim=False, fallback=False):
    """A unigram model put together by hand, as protobuf bytes."""
    import struct

    def part(number, kind, body):
        size = bytes([len(body)]) if len(body) < 128 else bytes([len(body) & 127 | 128, len(body) >> 7])
        return bytes([number << 3 | kind]) + (size if kind == 2 else b"") + body

    pieces_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces_ += [(f"<0x{i:02X}>", -20.0, 6) for i in range(256)] if fallback else []
    pieces_ += [("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -2.2, 1), ("▁a", -1.0, 1), ("c", -4.0, 1), ("a▁b", -1.5, 1)]
    out = b"".join(part(1, 2, part(1, 2, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([k])) for p, s, k in pieces_)
    trainer = b"\x18\x01" + (b"\x98\x02\x01" if fallback else b"")  # unigram; byte fallback is field 35
    return out + part(2, 2, trainer) + part(3, 2, b"\x18\x01\x20" + bytes([trim]) + b"\x28\x01")


@pytest.mark.parametrize(("trim", "fallback"), [(False, False), (True, False), (True, True)])
def test_models_that_join_words(spark, trim, fallback):
    """A unigram model with a piece across words, with and without trimmed blanks, encodes whole texts as the other library does."""
    import sentencepiece

    data = hand_made(trim, fallback)
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["ab a", "a b", "  ab   ba ", "", None, "cab abba a b", "b", "é a" if fallback else "zz a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pieces.encoded(docs, data, one_in=1)
    assert by_row(out, "doc_id", "ids") == sorted(((i, library.encode(t or "")) for i, t in enumerate(texts)), key=repr)
    assert out.filter("n_differ > 0").count() == 0 and out.filter("n_checked > 0").count() == len(texts)
    back = pieces.decoded(out.select("doc_id", "ids"), data)
    assert by_row(back, "doc_id", "text") == sorted(((i, library.decode(library.encode(t or ""))) for i, t in enumerate(texts)), key=repr)


@needs_model
def test_ids_come_from_the_backend():
    """A library that is wrong changes the count of differences and no id."""
    coder = pieces.Coder(piece_model())
    right, *_ = coder.encode(["some words here", "some more"])
    coder = pieces.Coder(piece_model(), one_in=1)
    coder.reference = type("Wrong", (), {"encode": lambda self, x, num_threads: [[1]] * len(x), "piece_to_id": lambda self, x: 1})()
    ids, _, checked, differ = coder.encode(["some words here", "some more"])
    assert ids.tolist() == right.tolist() and checked.tolist() == differ.tolist() == [3, 2]


def test_pieces_unigram():
    """A unigram model put together by hand, as protobuf bytes."""

    def part(number, kind, body):
        return bytes([number << 3 | kind]) + (bytes([len(body)]) if kind == 2 else b"") + body

    import struct

    out = b""
    for piece, score, kind in (("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -2.2, 1), ("▁a", -1.0, 1)):
        out += part(1, 2, part(1, 2, piece.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind]))
    out += part(2, 2, b"\x18\x01") + part(3, 2, b"\x18\x01\x20\x00\x28\x01")
    model = pieces.Model.parse(out)
    assert model.unigram and not model.byte_fallback and model.dummy_prefix and not model.trim and model.pieces[4] == "ab"
    assert model.backend().encode("ab a").tokens == ["▁a", "b", "▁a"]
