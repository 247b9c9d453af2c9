"""URL filter, token counts, decontamination, archives, licences."""

import base64
import hashlib
import random

import numpy as np
import pytest

from polescale.llm import licenses, textnp, tokencount, urlfilter, warc


def test_urls(spark):
    cases = {
        "http://a.com/x": ("a.com", "/x", "com/", "allow"),
        "https://WWW.Example.com/en/1?q=1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "x://b.net/fr/2#top": ("b.net", "/fr/2", "net/fr/", "block"),
        "x://b.net/fr": ("b.net", "/fr", None, "allow"),
        "x://a.com?q": ("a.com", "", None, "allow"),
        "http://casino.example.org/": ("casino.example.org", "/", None, "block"),
        "http://casinox.example.org/": ("casinox.example.org", "/", None, "allow"),
        "http://free.example.org/": ("free.example.org", "/", None, "allow"),
        "http://free-free.example.org/": ("free-free.example.org", "/", None, "allow"),
        "http://free-bets.example.org/": ("free-bets.example.org", "/", None, "block"),
        "no scheme casino": ("", "", None, "block"),
        "http://a.example.org/c%61sino": ("a.example.org", "/c%61sino", None, "block"),
        "http://a.example.org/%zz%": ("a.example.org", "/%zz%", None, "allow"),
        "x://" + "a/" * 200_000 + "porn": ("a", "/" + "a/" * 199_999 + "porn", None, "block"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u, 1) for i, u in enumerate(cases)] + [(99, None, 2)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host int")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and got[99] == cases[None]
    assert urlfilter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_terms_and_ties(spark):
    rows = spark.createDataFrame([(1, "http://x.org/alpha-beta", "r"), (None, "http://x.org/Gamma", "r"), (None, "http://x.org/Gamma", "r"), (3, "http://x.org/alpha", "r")], "page_id long, url string, rule string")
    got = sorted((str(r.page_id), r.rule, r.verdict) for r in urlfilter.filter_urls(rows, [], {"alpha": 0.4, "beta": 0.6, "gamma": 1.0}).collect())
    assert got == [("1", None, "block"), ("3", None, "allow"), ("None", None, "block"), ("None", None, "block")]
    both = [("x.org", "/al", "block"), ("org", "/alpha", "allow"), ("x.org", "/al", "allow")]
    assert {r.page_id: (r.rule, r.verdict) for r in urlfilter.filter_urls(rows, both, {}).collect()}[3] == ("org/alpha", "allow")
    assert {r.page_id: (r.rule, r.verdict) for r in urlfilter.filter_urls(rows, both[::2], {}).collect()}[3] == ("x.org/al", "block")


PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
POOL = " \n\t\x1c\x85  'sdtlmrveabcXYZ019٠½²éßあ漢🙂́!?.,-_<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


def strange(rng):
    x = "".join(rng.choice(POOL) for _ in range(rng.randrange(0, 40)))
    return x[:7] + "<|endoftext|>" + x[7:] if rng.random() < 0.2 else x


def test_tokens_as_the_library(spark, library):
    rng = random.Random(1)
    rows = [(i, strange(rng), "k") for i in range(1500)] + [(9000, None, "k"), (9001, ""), (9001, "")][:1] + [(9001, "", "k"), (9001, "", "k"), (9002, "word " * 3000, "k"), (9003, "x" * 5000, "k")]
    got = tokencount.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH).collect()
    texts = {i: t or "" for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        n = library(texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def prefixes(library, x):
    """Ends of characters in bytes and the library's tokens up to each."""
    return [(len(x[:k].encode()), library(x[:k])) for k in range(len(x) + 1)]


def test_every_prefix(library):
    c = tokencount.counter(PATH)
    rng = random.Random(2)
    texts = [strange(rng) for _ in range(400)] + ["", "I'll we've they're 'tis x'", "a   b \n\n c\t\td  ", "\n\n\nword", "x" * 300, " " * 60 + "y", "é" * 50, "a <|endoftext|><|endoftext|> b", "<|endoftext", "Straßenbahnhöfe international abcabcabc"]
    for x in texts:
        n = len(x.encode())
        ends, counts = tokencount.counts_of(tokencount.packed(c.steps(x)), n)
        assert list(zip(ends.tolist(), counts.tolist(), strict=True)) == prefixes(library, x), repr(x)


def test_wide_steps():
    steps = np.array([1, tokencount.INSIDE, 300, -300, 2], np.int32)
    ends, counts = tokencount.counts_of(tokencount.packed(steps), 5)
    assert ends.tolist() == [0, 1, 3, 4, 5] and counts.tolist() == [0, 1, 301, 1, 3]


def test_budgets_and_truncations(spark, library):
    rng = random.Random(4)
    rows = [(i, strange(rng)) for i in range(60)] + [(100, None), (101, "x" * 5000), (None, "word " * 40)]
    table = tokencount.prefix_table(spark.createDataFrame(rows, "doc_id long, text string"), PATH).cache()
    for budget in (0, 5, 60):
        for r in tokencount.budgets(table, budget).collect():
            fit = max((e, n) for e, n in prefixes(library, dict(rows)[r.doc_id] or "") if n <= budget) if r.doc_id != 101 else None
            assert fit is None and 0 < r.fit_bytes < 5000 - budget * (budget == 0) or (r.fit_bytes, r.fit_tokens) == (fit or (0, 0))
            if r.doc_id == 101:
                assert library("x" * r.fit_bytes) <= budget and (all(library("x" * k) > budget for k in range(r.fit_bytes + 1, r.fit_bytes + 40)))
    for size in (0, 7, 1 << 20):
        for r in tokencount.truncations(table, size).collect():
            x = (dict(rows)[r.doc_id] or "").encode()[:size].decode("utf-8", "ignore")
            assert (r.cut_bytes, r.cut_tokens) == (len(x.encode()), library(x))
    assert tokencount.budgets(table.where("false"), 3).count() == 0


def pages(spark):
    rows = [(5, "http://a/1", "same"), (7, "http://a/2", "same"), (6, None, "été"), (8, "http://a/ 3", None), (9, "u", ""), (None, "v", "same"), (7, "w", "same")]
    rows += [(100 + i, f"http://b/{i}", f"<p>{i % 7}</p>" * (i % 5 * 40)) for i in range(60)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def test_archives_round_trip(spark, tmp_path):
    df = pages(spark)
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(spark, df, folder, shard_bytes=6000, roll_bytes=700).collect()
    assert len(manifest) > 3 and sum(m.n_records for m in manifest) == df.count() and max(m.seq for m in manifest) > 0
    got = warc.read_archives(spark, folder).collect()
    html = sorted((str(r.page_id), r.html or "") for r in df.collect())
    assert {(str(r.page_id), r.html) for r in got if r.record_type == "response"} <= set(html)
    assert sorted(str(r.page_id) for r in got) == [i for i, _ in html]
    by: dict = {}
    for i, h in html:
        by.setdefault(h, []).append(i)
    for r in got:
        assert r.payload_digest in {base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() for h in by}
    response = {r.payload_digest: r.page_id for r in got if r.record_type == "response"}
    assert len(response) == len(by) == sum(r.record_type == "response" for r in got)
    assert all(r.refers_to == response[r.payload_digest] for r in got if r.record_type == "revisit")
    assert response[base64.b32encode(hashlib.sha1(b"same").digest()).decode()] == 7


def test_archives_are_the_same_again(spark, tmp_path):
    df = pages(spark).where("page_id is not null").dropDuplicates(["page_id"])
    one = warc.write_archives(spark, df.repartition(3), f"file://{tmp_path}/a", shard_bytes=6000, roll_bytes=700).collect()
    two = warc.write_archives(spark, df.repartition(7).orderBy("url"), f"file://{tmp_path}/b", shard_bytes=6000, roll_bytes=700).collect()
    assert sorted((m.file, m.sha256) for m in one) == sorted((m.file, m.sha256) for m in two)
    assert not list(tmp_path.glob("*/_temporary*"))


def test_outlying_ids(spark, tmp_path):
    """Ids as far apart as they can be: shards hold the same bytes, and reading gives every page."""
    rows = [(i, f"u{i}", "x" * 400 + str(i)) for i in range(300)] + [(-(2**63), "low", "low"), (2**63 - 1, "high", None), (2**60, "far", "y" * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for k, more in enumerate(({}, {"most_borders": 0})):
        manifest = warc.write_archives(spark, df, f"file://{tmp_path}/{k}", shard_bytes=9200, **more).collect()
        by = {}
        for m in manifest:
            by[m.shard] = by.get(m.shard, 0) + m.n_records
        assert sorted(by) == list(range(len(by))) and len(by) > 25 and max(by.values()) <= 11
        assert sorted(r.page_id for r in warc.read_archives(spark, f"file://{tmp_path}/{k}").collect()) == sorted(i for i, *_ in rows)
        assert k == 0 or sorted((m.file, m.sha256) for m in manifest) == before
        before = sorted((m.file, m.sha256) for m in manifest)


def test_left_over_files_go(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "_temporary-0-shard.warc.gz").write_bytes(b"of an attempt that failed")
    long = "é" * 3_000_000
    names = "uid int, _text int, fact int, shard int, size int, _url int, s int, p int"
    df = spark.createDataFrame([(1, "u", long, *range(8)), (None, None, long, *range(8)), (1, "u", long, *range(8))], f"page_id long, url string, html string, {names}")
    warc.write_archives(spark, df, f"file://{tmp_path}/w")
    assert not list((tmp_path / "w").glob("_temporary*"))
    got = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert sorted(r.record_type for r in got) == ["response", "revisit", "revisit"] and {r.payload_bytes for r in got} == {6_000_000}
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {1}


def test_repeated_attempt(tmp_path):
    """A store that doesn't rename onto an existing file still takes a task's second attempt."""

    class Strict:
        def __init__(self, store):
            self.store = store

        def move(self, a, b):
            if (tmp_path / "shard-000000-00000.warc.gz").exists():
                raise OSError("exists")
            self.store.move(a, b)

        def __getattr__(self, name):
            return getattr(self.store, name)

    done = []
    for _ in range(2):
        f = warc._File(f"file://{tmp_path}", 0, 0)
        f.fs = Strict(f.fs)
        f.add(b"record")
        done.append(f.close())
    assert done[0] == done[1] and [p.name for p in tmp_path.iterdir()] == ["shard-000000-00000.warc.gz"]


def test_small_payloads_and_empty(spark, tmp_path):
    warc.write_archives(spark, pages(spark), f"file://{tmp_path}/w", min_bytes=5)
    got = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 5) and any(r.record_type == "revisit" for r in got)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(spark, none, f"file://{tmp_path}/n")
    assert warc.read_archives(spark, f"file://{tmp_path}/n").count() == 0


def test_licences(spark):
    mit = "Released under the MIT License."
    rows = [
        (1, "p/LICENSE", "Intro\n" + mit),
        (2, "p/a/b/code.txt", "nothing to see"),
        (3, "p/a/head.txt", "x = 1\nLicensed under the Apache License, Version 2.0.\ny = 2"),
        (4, "p/a/COPYING.md", "This work is licensed under the GNU General Public License, version 3."),
        (5, "p/a/b/c/deep.txt", None),
        (6, "q/code.txt", "the license of this is unknown to the public"),
        (7, "q/x/only.txt", mit),
        (8, "q/x/y/z.txt", "words"),
        (9, None, "words"),
        (9, None, "words"),
        (10, "top.txt", ""),
    ]
    got = sorted((r.doc_id, r.licence, r.origin, r.inherited_from) for r in licenses.scan(spark, spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, path string, text string, score string")).collect())
    assert got == [(1, "MIT", "own", None), (2, "GPL-3.0", "inherited", "p/a"), (3, "Apache-2.0", "own", None), (4, "GPL-3.0", "own", None), (5, "GPL-3.0", "inherited", "p/a"), (6, None, None, None), (7, "MIT", "own", None), (8, "MIT", "inherited", "q/x"), (9, None, None, None), (9, None, None, None), (10, None, None, None)]
    assert licenses.scan(spark, spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_cues_lose_nothing():
    """A unit without any cue stays below the threshold."""
    import math

    idf, _, rows, cues = licenses.model(licenses.TEMPLATES, licenses.THRESHOLD)
    for k in range(len(licenses.TEMPLATES)):
        rest = math.sqrt(sum(w * w for t, _, word, w in rows if t == k and word not in cues))
        assert rest < licenses.THRESHOLD


def test_words_as_the_pattern():
    import numpy as np
    import pyarrow as pa
    from brute import WORD

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \t\n\x0b\x1c\u00a0é\u3000Z") for _ in range(rng.randrange(0, 25))) for _ in range(300)] + [None, ""]
    found = []
    for _, _, data, offs in textnp.slices(pa.array(texts), 200):
        s, e, n = textnp.words(data, offs)
        found += [bytes(data[a:b]).decode() for a, b in zip(s, e)]
        assert n.sum() == len(s) == len(textnp.word_hashes(data, s, e))
    assert found == [w for t in texts for w in WORD.findall(t or "")]
    assert len(np.unique(textnp.word_hashes(*(lambda d, o: (d, *textnp.words(d, o)[:2]))(np.frombuffer(b"Ab aB ab b", np.uint8), np.array([0, 10]))))) == 2
