"""The registered queries themselves over the smallest tables: columns, splits, thresholds and digests, by plain Python."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import regex
import xxhash

from millrace.llm import entries

HOME = "/root/testdata/sf0.001"
WORDS = regex.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{HOME}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in t}


@pytest.fixture(scope="module")
def vectors():
    t = pq.read_table(f"{HOME}/embeddings.parquet")
    return t["vec_id"].to_numpy(), np.stack(t["embedding"].to_numpy(zero_copy_only=False)).astype(np.float64)


def rest(i, n):
    return zlib.crc32(str(i).encode()) % n


def rows(df, *columns):
    assert df.columns[: len(columns)] == list(columns)
    return df.toPandas()


def nearest(ids, x, q, k=20):
    scores = np.array([float(np.dot(r, x[q])) for r in x])
    order = [i for i in np.lexsort((ids, -scores)) if i != q][:k]
    return [int(ids[i]) for i in order], scores[order]


def test_op1(spark, vectors):
    ids, x = vectors
    got = rows(entries.op1_ann(spark, HOME), "query_id", "rank", "vec_id", "score")
    assert sorted(set(got.query_id)) == sorted(i for i in ids if i % 20 == 0) and (got.groupby("query_id").size() == 20).all() and (got.query_id != got.vec_id).all()
    place, hits = {i: n for n, i in enumerate(ids)}, 0
    for q, part in got.sort_values("rank").groupby("query_id"):
        assert part["rank"].tolist() == list(range(1, 21)) and part.score.is_monotonic_decreasing
        assert np.allclose(part.score, [x[place[v]] @ x[place[q]] for v in part.vec_id], rtol=1e-12)
        hits += len(set(part.vec_id) & set(nearest(ids, x, place[q])[0]))
    assert hits >= 0.9 * len(got)


def test_op4(spark, vectors):
    ids, x = vectors
    whole = np.floor(64 * x)
    got = rows(entries.op4_vafile(spark, HOME), "query_id", "rank", "vec_id", "score").sort_values("rank")
    for n in np.flatnonzero(ids % 20 == 0):
        part = got[got.query_id == ids[n]]
        best, scores = nearest(ids, whole, n)
        assert part.vec_id.tolist() == best and part.score.tolist() == scores.astype(int).tolist()


def test_op2(spark, texts):
    got = rows(entries.op2_toxicity(spark, HOME), "doc_id", "held_out", "score", "predicted").set_index("doc_id")
    assert set(got.index) == set(texts) and got.score.between(0, 1).all()
    assert all(r.held_out == (rest(i, 4) == 2) and r.predicted == int(r.score >= 0.3) for i, r in zip(got.index, got.itertuples()))


def test_op3(spark, texts):
    seen = Counter()
    raw = {i: t.encode() for i, t in texts.items()}
    key = lambda b: xxhash.xxh3_128_intdigest(b)
    for b in raw.values():
        seen.update(key(b[i : i + 400]) for i in range(len(b) - 399))
    got = rows(entries.op3_suffix_dedup(spark, HOME), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").set_index("doc_id")
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, bool)
        for at in range(len(b) - 399):
            if seen[key(b[at : at + 400])] > 1:
                gone[at : at + 400] = True
        kept = np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if b else 0
        assert tuple(got.loc[i]) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_op5(spark):
    docs = pq.read_table(f"{HOME}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()
    got = rows(entries.op5_langid(spark, HOME), "doc_id", "held_out", "lang_pred", "score").set_index("doc_id")
    assert all(got.held_out[r["doc_id"]] == (rest(r["doc_id"], 3) == 1) for r in docs) and got.score.between(0, 1).all()
    held = [r for r in docs if rest(r["doc_id"], 3) == 1 and r["lang"]]
    assert sum(got.lang_pred[r["doc_id"]] == r["lang"] for r in held) >= 0.95 * len(held)


def test_op6(spark, texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(entries.WORD_BPE)
    got = rows(entries.op6_bpe(spark, HOME), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256").set_index("doc_id")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in texts.items():
        ids = own.encode(t, add_special_tokens=False).ids
        assert tuple(got.loc[i]) == (len(ids), sha(" ".join(map(str, ids))), sha(own.decode(ids, skip_special_tokens=False)))


def test_op7(spark, texts):
    prints = {}
    for i, t in texts.items():
        w = [x.lower() for x in WORDS.findall(t.encode())]
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    got = rows(entries.op7_simhash(spark, HOME), "doc_id", "fingerprint", "component_id").set_index("doc_id")
    assert {i: (f"{prints[i]:016x}", root[i]) for i in texts} == {i: tuple(got.loc[i]) for i in texts}


def test_op8(spark, texts):
    got = rows(entries.op8_token_counts(spark, HOME), "doc_id", "n_tokens").set_index("doc_id")
    assert set(got.index) == set(texts) and all((got.n_tokens[i] > 0) == bool(t.strip()) for i, t in texts.items())


def test_op9(spark, texts):
    got = rows(entries.op9_lm_scoring(spark, HOME), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").set_index("doc_id")
    tokens = {i: [x.lower() for x in WORDS.findall(t.encode())] + [b" "] for i, t in texts.items()}
    seen = Counter(w for i, x in tokens.items() if rest(i, 7) != 2 for w in x)
    n, v = sum(seen.values()), len(seen)
    for i, x in tokens.items():
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (rest(i, 7) == 2, len(x), sum(seen[w] > 0 for w in x), n)
        assert math.isclose(r.base_score, sum(math.log10((seen[w] + 1) / ((n + 1) * (v + 1))) for w in x), rel_tol=1e-9) and r.score <= 0
    held = got[got.held_out]
    assert held.score.sum() > 0.75 * held.base_score.sum()


def test_op10(spark):
    docs = pq.read_table(f"{HOME}/documents.parquet", columns=["doc_id", "source", "text"]).to_pylist()
    size = {r["doc_id"]: len(WORDS.findall((r["text"] or "").encode())) for r in docs}
    source = {r["doc_id"]: r["source"] for r in docs}
    names = sorted({s for s in source.values() if s is not None}) + ([None] if None in source.values() else [])
    have = {s: sum(n for i, n in size.items() if source[i] == s) for s in names}
    weigh = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(have.values()), list(names)
    while open_:
        share = {s: left * weigh[s] / sum(weigh[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * have[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * have[s]
            left -= target[s]
        open_ = [s for s in open_ if s not in over]
    got = rows(entries.op10_mixing(spark, HOME), "doc_id", "size", "source_size", "target", "taken").set_index("doc_id")
    taken = Counter()
    for i, r in zip(got.index, got.itertuples()):
        assert r.size == size[i] and r.source_size == have[source[i]] and math.isclose(r.target, target[source[i]], rel_tol=1e-9) and r.taken <= 2 * size[i] and (not size[i] or r.taken % size[i] == 0)
        taken[source[i]] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(size[i] for i in size if source[i] == s) for s in names)
    assert entries.op10_mixing(spark, HOME).toPandas().set_index("doc_id").taken.to_dict() == got.taken.to_dict()


def test_all_are_registered():
    import corpus_pipeline

    assert sorted(entries.queries()) == sorted([*(f"op{n}_{x}" for n, x in enumerate("ann toxicity suffix_dedup vafile langid bpe simhash token_counts lm_scoring mixing vector_codes hard_negatives token_files".split(), 1)), "pipeline"])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "mixture", "tokens"]
