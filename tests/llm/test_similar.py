"""Near duplicates by Jaccard similarity against brute force."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
from test_duplicates import smallest_reachable

import corpus_pipeline
from heartwood.llm.similar import ROUND, candidates, fingerprint, grid_cells, one_per_similar, shape, tile_links, width
from heartwood.session import work_dir

WORDS = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("a", "eno", "iru", "ota")]

def sets(texts, words=5):
    split = [t.lower().split() for t in texts]
    return [{tuple(t[i : i + words]) for i in range(max(len(t) - words, 0) + 1)} for t in split]


def survivors(texts):
    """The rows that brute force leaves, and the similarity of all linked pairs."""
    found = sets(texts)
    pairs = [(i, j, len(a & b) / len(a | b)) for i, a in enumerate(found) for j, b in enumerate(found[:i])]
    near = [(i, j) for i, j, s in pairs if s >= 0.8]
    return {k for k, least in enumerate(smallest_reachable(len(texts), near)) if k == least}, [s for _, _, s in pairs if s >= 0.8]


def planted(seed, per_step=12):
    """Texts of 200 words and copies with 1 to 5 words changed: similarities from 0.95 down to below 0.8."""
    draw = random.Random(seed)
    texts = []
    for changed in (0, 1, 2, 3, 4, 5):
        for _ in range(per_step):
            base = [draw.choice(WORDS) + draw.choice(WORDS) for _ in range(200 if changed != 1 else 500)]
            copy = list(base)
            for at in draw.sample(range(len(base)), changed):
                copy[at] = "changed"
            texts += [" ".join(base), "  ".join(copy).upper()]
    return texts


def test_near_copies_from_least_similarity_up_are_grouped(spark):
    texts = planted(1)
    expected, similar = survivors(texts)
    assert min(similar) < 0.83 and sum(s < 0.95 for s in similar) > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in one_per_similar(docs).collect()) == sorted(expected)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted(expected)


def test_chains_of_near_copies_end_in_one_row(spark):
    draw = random.Random(2)
    text = [draw.choice(WORDS) + draw.choice(WORDS) for _ in range(200)]
    texts = [" ".join(text)]
    for at in range(5, 195, 5):  # neighbours are alike, ends are not
        text[at] = f"step{at}"
        texts.append(" ".join(text))
    expected, _ = survivors(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in one_per_similar(docs).collect()] == sorted(expected) == [0]


def test_tiles_find_what_hubs_left():
    a, b = np.arange(0, 100), np.arange(1000, 1100)
    rows = [a, a[5:], b, b[3:], np.arange(500, 600)]
    assert sorted(tile_links(rows, np.array([7, 7, 9, 11, 13]), 0.8)) in ([(2, 3)], [(3, 2)])


def test_awkward_rows(spark, awkward, nothing):
    left = one_per_similar(awkward).collect()
    ids = [r.doc_id for r in left]
    assert sum(i in (110, 111, 112, 113) for i in ids) == 1 and 110 in ids
    assert sum(i in (100, 101, 102) for i in ids) == 1 and 100 in ids
    assert set(range(30)) <= set(ids) and None in ids and len(ids) == len(set(ids))
    assert left[0].__fields__ == awkward.columns
    assert one_per_similar(nothing).collect() == []


def test_fingerprints_are_majority_bits_and_cells_count_ones_of_segments():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**64, 41, np.uint64))
    each = [fingerprint(keys[k : k + 1], 3) for k in range(len(keys))]
    bits = np.array([np.unpackbits(x.view(np.uint8), bitorder="little") for x in each]).sum(axis=0)
    mine = fingerprint(keys, 3)
    assert (np.unpackbits(mine.view(np.uint8), bitorder="little") == (2 * bits > len(keys))).all()
    ones = np.unpackbits(mine.view(np.uint8), bitorder="little").reshape(-1, 2).sum(axis=1)
    cells = grid_cells(mine[None], 4, 5)[0]
    assert cells.tolist() == [sum(int(ones[4 * g + k]) * 3**k for k in range(4)) * 5 + g for g in range(5)]


def test_sets_of_least_similarity_share_a_cell_of_the_grid(spark):
    draw = np.random.default_rng(4)
    rows = []
    for pair in range(400):
        a, c = (4, 4) if pair % 2 else (180, 160)  # 4 of 5, and 160 of 200 shingles
        base = draw.integers(0, 2**64, 5 if pair % 2 else 200, np.uint64)
        rows += [(2 * pair, base[:a]), (2 * pair + 1, base if pair % 2 else base[a - c :])]
    for size in (800, 300_000):
        dims, groups, short = shape(size, 0.8)
        prints = [(n, len(x), fingerprint(np.unique(x), width(dims, short)).tobytes()) for n, x in rows]
        nodes = spark.createDataFrame(prints, "node long, size long, print binary")
        together = {}
        for r in candidates(nodes, 0.8, dims, groups, short).collect():
            together.setdefault(r.bucket, set()).add(r.node)
        found = sum(any({2 * p, 2 * p + 1} <= some for some in together.values()) for p in range(400))
        assert found >= 398  # each is missed with probability 0.0004
        assert sum(map(len, together.values())) < 2 * len(rows)  # no more than the pairs, and few by chance


def test_a_group_of_near_fingerprints_emits_one_row_each(spark):
    draw = np.random.default_rng(5)
    base = draw.integers(0, 2**64, 200, np.uint64)
    sets = [np.unique(np.append(base, draw.integers(0, 2**64, 2, np.uint64))) for _ in range(300)]
    dims, groups, short = shape(300, 0.8)
    prints = [(n, len(x), fingerprint(x, width(dims, short)).tobytes()) for n, x in enumerate(sets)]
    nodes = spark.createDataFrame(prints, "node long, size long, print binary")
    assert candidates(nodes, 0.8, dims, groups, short).count() < 300 * groups


def test_no_texts_are_written_down(spark, tmp_path):
    draw = random.Random(6)
    texts = [" ".join(f"{draw.getrandbits(48):x}" for _ in range(4000)) for _ in range(30)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    folder = Path(work_dir(spark).removeprefix("file:"))
    before = set(folder.rglob("*.parquet"))
    assert one_per_similar(spark.read.parquet(f"{tmp_path}/docs")).count() == 30
    written = sum(path.stat().st_size for path in set(folder.rglob("*.parquet")) - before if path.is_file())
    assert 0 < written < sum(map(len, texts)) / 10


def test_buckets_name_their_hub_and_count_and_hold_sets_of_like_sizes(spark):
    draw = np.random.default_rng(7)
    prints = [draw.integers(0, 2**64, (1, 40), np.uint64) for _ in range(3)]
    rows = [(10 * k + n, 1000 if n < 4 else 700, prints[k].tobytes()) for k in range(3) for n in range(5)]
    nodes = spark.createDataFrame(rows, "node long, size long, print binary")
    found = candidates(nodes, 0.8, 5, 2 * ROUND + 1, 2 * ROUND + 1).collect()  # in three rounds
    assert {(r.node, r.n) for r in found} == {(10 * k + n, 4) for k in range(3) for n in range(4)} and len(found) == 12
    assert all(len({r.hub for r in found if r.bucket == bucket}) == 1 for bucket in {r.bucket for r in found})
    assert all(r.hub // 10 == r.node // 10 for r in found)
