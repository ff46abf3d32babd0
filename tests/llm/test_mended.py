"""Links inside topics, and texts that cuts join."""

import numpy as np
import pytest

from tessera.llm import decontaminate, embedding_dedup


def topic(n, dim, mutual, pairs, seed):
    """Unit vectors of one topic with a mutual cosine, and planted pairs at 0.905 and 0.95."""
    rng = np.random.default_rng(seed)
    centre = np.zeros(dim)
    centre[0] = 1

    def free(m):
        r = rng.standard_normal((m, dim))
        r[:, 0] = 0
        return r / np.linalg.norm(r, axis=1, keepdims=True)

    a, b = np.sqrt(mutual), np.sqrt(1 - mutual)
    r = free(n)
    x, planted = a * centre + b * r, []
    for k in range(pairs):
        want = 0.905 if k % 2 else 0.95
        c = (want - mutual) / (1 - mutual)
        other = free(1)[0]
        other -= (other @ r[k]) * r[k]
        other /= np.linalg.norm(other)
        x[n - 1 - k] = a * centre + b * (c * r[k] + np.sqrt(1 - c * c) * other)
        planted.append((k, n - 1 - k))
    return x, planted


@pytest.mark.parametrize("mutual", [0.8, 0.55])
def test_links_inside_a_topic_are_kept(spark, mutual):
    n = 3000
    x, planted = topic(n, 128, mutual, 300, 1)
    far = np.random.default_rng(2).standard_normal((500, 128))
    rows = [(i, v) for i, v in enumerate(np.concatenate([x, far]).tolist())]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    kept = np.mean([got[a][1] == got[b][1] for a, b in planted])
    assert kept >= 0.99
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert np.mean([got[i][0] == links[i] for i in range(n)]) >= 0.99 and sum(got[i][0] for i in range(n, n + 500)) == 0


def words(letter, n=12):
    return [f"{letter}{i}" for i in range(n)]


@pytest.mark.parametrize("shard_bytes", [8 << 20, 40])
def test_no_item_is_left_after_cuts(spark, shard_bytes):
    w, v, u, filler = words("w"), words("v"), words("u"), words("f", 150)
    nested = [*filler, *w[:6], *v[:5], *u, *v[5:], *w[6:], *filler]
    twice = [*filler, *w, *filler[:3], *w, *filler]
    texts = {1: nested, 2: twice, 3: filler, 4: w, 5: [*filler, *w[:9], *filler], 6: None}
    rows = [(i, None if t is None else " ".join(t), "x", i, 0) for i, t in texts.items()] + [(2, " ".join(twice), "y", 2, 0), (None, " ".join(nested), "z", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hit_doc string, _hit_row long, _hit_spans int")
    items = spark.createDataFrame([("a", " ".join(w)), ("b", " ".join(v)), ("c", " ".join(u))], "item_id string, text string")
    out = decontaminate.decontaminate(docs, items, shard_bytes=shard_bytes)
    assert out.columns == docs.columns
    found = decontaminate.find_contamination(out, items).collect()
    assert all(not r.spans for r in found)
    left = {}
    for r in out.collect():
        left.setdefault(r.doc_id, []).append(r.text)
    assert sorted(map(str, left)) == ["1", "2", "3", "5", "6", "None"] and len(left[2]) == 2 and left[6] == [None]
    assert left[1][0].split() == [*filler, *filler] == left[None][0].split() and left[3] == [" ".join(filler)] and left[5] == [" ".join(texts[5])]
