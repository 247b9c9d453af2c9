"""Very long texts, ties, repeated rows, null ids and clashing names, for the operators whose tests stand elsewhere."""

import hashlib

import brute

from polescale.llm import licenses, minhash, suffix, tokencount

LONG = " ".join(f"w{i % 40_000}x{i % 7}" for i in range(250_000))
NAMES = "_uid string, _id string, _text string, node string, cid string, first string, key string, size string, words string, n string, doc string, at string, bits string, anchor string, unit string, found string, word string, unit_ string, whole string, score string, licence string"


def frame(spark, rows, own):
    k = len(NAMES.split(", "))
    return spark.createDataFrame([(*r, *["x"] * k) for r in rows], f"{own}, {NAMES}")


def test_near_duplicates(spark):
    rows = [(5, LONG), (9, LONG + " more"), (None, LONG), (5, "a b c d e f"), (None, None), (-(2**63), "A b c d e f"), (2**63 - 1, "a b c d e f"), (7, "\n"), (7, "\n")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark, frame(spark, rows, "doc_id long, text string")).collect()), key=str)
    n = len(brute.shingles(LONG))
    low = -(2**63)
    want = [(5, n, 5, True), (9, n + 1, 5, False), (None, n, 5, False), (5, 2, low, False), (None, 0, None, True), (low, 2, low, True), (2**63 - 1, 2, low, False), (7, 0, 7, True), (7, 0, 7, True)]
    assert got == sorted(want, key=str)


def test_exact_threshold_links(spark):
    """85 of 100 links, 84 of 99 does not: ties go to linking."""
    words = [f"p{i}" for i in range(96 + 8)]
    rows = [(1, " ".join(words[:96])), (2, " ".join(words[: 85 + 4] + [f"q{i}" for i in range(8)]))]
    a, b = (brute.shingles(t) for _, t in rows)
    both, union = len(a & b), len(a | b)
    for percent in (100 * both // union, 100 * both // union + 1):
        got = {r.doc_id: r.kept for r in minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
        assert got[2] == (100 * both < percent * union)


def test_components_go_to_the_end(spark):
    """A long path needs many rounds; nothing ends them early."""
    from polescale.llm.common import Workspace, components

    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000), (2000, 2001), (2001, 2000)], "a long, b long")
    got = {r.node: r.comp for r in components(Workspace(spark, "c"), edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {2000: 2000, 2001: 2000}


class Elsewhere:
    """A session on a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, other=None: other)

    class sparkContext:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)


def test_clusters_need_a_shared_folder(spark):
    import pytest

    from polescale.llm.common import shared_dir

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(Elsewhere)
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_work_tables_go(spark, tmp_path):
    from pathlib import Path

    from polescale.llm.common import WRITING, Workspace, scratch

    with scratch():
        ws = Workspace(spark, "gone")
        t = ws.save(spark.range(10).repartition(2), "t")
        assert t.count() == 10 and Path(ws.root).is_dir()
    assert not Path(ws.root).exists() and all(spark.conf.get(k, None) is None for k in WRITING)


def test_repeats(spark):
    rows = [(5, LONG), (5, LONG), (None, LONG), (None, None), (3, ""), (-(2**63), "z" * 1_000_000)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(spark, frame(spark, rows, "doc_id long, text string")).drop("kept_text").collect()), key=str)
    n, none = len(LONG.encode()), hashlib.sha256(b"").hexdigest()
    first = brute.repeats([(1, LONG)])[1]
    z = hashlib.sha256(b"z").hexdigest()
    want = [(5, *first), (5, n, n, 1, none), (None, n, n, 1, none), (None, 0, 0, 0, none), (3, 0, 0, 0, none), (-(2**63), 1_000_000, 999_999, 1, z)]
    assert got == sorted(want, key=str)


def test_licences(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "a/x.txt", LONG + "\n" + mit), (1, "a/x.txt", LONG + "\n" + mit), (None, "a/LICENSE", f"{gpl}\n{mit}"), (None, None, mit), (3, "a/b/c/d/e/y.txt", None), (3, "a", ""), (4, "/", "words"), (5, "b//LICENSE", mit), (6, "b/z", "w")]
    got = sorted(((r.doc_id, r.path, r.licence, r.origin, r.inherited_from) for r in licenses.scan(spark, frame(spark, rows, "doc_id long, path string, text string")).collect()), key=str)
    # equal scores: the first name
    want = [(1, "a/x.txt", "MIT", "own", None), (1, "a/x.txt", "MIT", "own", None), (None, "a/LICENSE", "GPL-3.0", "own", None), (None, None, "MIT", "own", None), (3, "a/b/c/d/e/y.txt", "GPL-3.0", "inherited", "a"), (3, "a", None, None, None), (4, "/", None, None, None), (5, "b//LICENSE", "MIT", "own", None), (6, "b/z", None, None, None)]
    assert got == sorted(want, key=str)


def test_tokens(spark):
    import public_tokenizers

    rows = [(None, "a b"), (None, "a b"), (1, None), (1, LONG)]
    got = tokencount.count_tokens(frame(spark, rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"), limit=2).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.over_limit) for r in got) == [("1", 0, False), ("1", len(LONG), True), ("None", 3, False), ("None", 3, False)]
