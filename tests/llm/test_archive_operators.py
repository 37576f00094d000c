"""Archives, manifests and periodic runs against plain loops."""

import base64
import collections
import functools
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import merkle, periodic_runs, warc


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class TestMerkle:
    @staticmethod
    def tree(leaves, fanout):
        """The root, and the siblings on each leaf's way."""
        paths, level, members = [[] for _ in leaves], list(leaves), [[k] for k in range(len(leaves))]
        while len(level) > 1:
            runs = [range(k, min(k + fanout, len(level))) for k in range(0, len(level), fanout)]
            for run in runs:
                for k in run:
                    for leaf in members[k]:
                        paths[leaf].append(("".join(level[j] for j in run if j < k), "".join(level[j] for j in run if j > k)))
            members = [[leaf for k in run for leaf in members[k]] for run in runs]
            level = [sha(*(level[k] for k in run)) for run in runs]
        return level[0], paths

    def brute(self, rows, fanout):
        groups = collections.defaultdict(list)
        for group, key, leaf in rows:
            groups[group].append((key is not None, key, leaf))
        names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
        trees = {g: self.tree([x[2] for x in sorted(groups[g])], fanout) for g in names}
        root, above = self.tree([trees[g][0] for g in names], fanout)
        return sorted(
            repr((g, key, leaf, trees[g][0], root, path + above[n]))
            for n, g in enumerate(names) for (_, key, leaf), path in zip(sorted(groups[g]), trees[g][1])
        )

    @pytest.mark.parametrize("fanout, block", [(2, 4), (2, 1024), (3, 9), (5, 4)])
    def test_paths(self, spark, fanout, block):
        rows = [("one", 7, sha("x"))]
        rows += [(g, k if k % 9 else None, sha(str(k % 50), g or "")) for n, g in ((70, "de"), (33, "ü"), (16, None), (5, "")) for k in range(n)]
        random.Random(fanout).shuffle(rows)
        df = spark.createDataFrame(rows, "g string, k long, leaf string").withColumn("_pos", F.lit(1)).withColumn("c0", F.lit(2)).repartition(3)
        found = merkle.merkle_paths(df, "g", "k", "leaf", fanout, block)
        assert found.columns == [*df.columns, "subroot", "root", "path"]
        got = [(r["g"], r["k"], r["leaf"], r["subroot"], r["root"], [tuple(x) for x in r["path"]]) for r in found.collect()]
        assert sorted(map(repr, got)) == self.brute(rows, fanout)
        folded = found.select(merkle.fold(F.col("leaf"), F.col("path")) == F.col("root"), merkle.fold(F.lit("x"), F.col("path")) == F.col("root"))
        assert folded.distinct().collect() == [(True, False)]

    def test_one_changed_byte_anywhere_is_noticed(self, spark, odd_docs):
        report = merkle.tamper_report(odd_docs, block=4).collect()
        rows = [r.asDict() for r in odd_docs.collect()]
        value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
        leaf = lambda r: sha(*(value(r[c]) for c in merkle.FIELDS))
        want = self.brute([(r["lang"], r["doc_id"], leaf(r)) for r in rows], 2)
        paths = [eval(x) for x in want]
        assert sorted((repr(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in report) == sorted(
            (repr(key), leaf_, sub, root, sha(*(a + b for a, b in path))) for _, key, leaf_, sub, root, path in paths
        )
        for r in report:
            same = r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 or r["doc_id"] == 30  # 30 has no text to count
            assert r["verified"] == bool(same) == (r["folded_root"] == r["root"])

    def test_empty(self, no_docs):
        assert merkle.tamper_report(no_docs).collect() == [] and merkle.manifest(no_docs).count() == 0

    def test_manifest(self, docs):
        found = merkle.manifest(docs)
        assert found.columns == ["doc_id", "lang", "leaf", "subroot", "root", "path"] and found.count() == docs.count()
        assert found.where(merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).count() == docs.count()


FORGED = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666:X>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = [
    (1, "http://a/ü?q=1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "http://e/a b\r\nX: y", FORGED * 3),
    (6, "http://f", "text\r\n\r\n" + FORGED + "WARC/1.0\r\nContent-Length: 99999999999999999999\r\n\r\n"), (7, "http://g", "é🙂" * 4000), (8, "http://h", "\r\n"),
    (9, "http://i", "\r\n\r\n"), (10, "http://j", "ends with \r\n"), (None, "http://k", "<p>one</p>"), (None, "http://l", "alone"), (None, "http://l", "alone"),
    (2, "http://a/2", "<p>one</p>"), (1, "http://a/ü?q=1", "<p>one</p>"), (11, "http://m", "WARC/1.0\r\n" * 500), (12, "http://n", FORGED.replace("5", "400")),
]


class TestWarc:
    @pytest.fixture(scope="class")
    def pages(self, spark):
        df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
        return df.withColumn("digest", F.lit(1)).withColumn("first", F.lit(2)).withColumn("path", F.lit("x")).coalesce(2)

    @staticmethod
    def want(rows):
        first = {}
        for i, _, html in rows:
            if i is not None:
                first[html or ""] = min(i, first.get(html or "", i))
        for i, _, html in rows:
            data, own = (html or "").encode(), first.get(html or "")
            again = own is not None and (i is None or own < i)
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            yield i, len(data), digest, "revisit" if again else "response", own if again else None

    def test_report(self, pages):
        assert sorted(map(repr, map(tuple, warc.page_report(pages).collect()))) == sorted(map(repr, self.want(PAGES)))

    @pytest.mark.parametrize("width", [37, 1000, 1 << 20])
    def test_records_are_those_of_a_loop_from_the_start(self, spark, pages, tmp_path, width):
        path = f"file://{tmp_path}/w"
        warc.write_warc(pages, path)
        want = []
        for name in (tmp_path / "w").glob("part-*"):
            data, at = name.read_bytes(), 0
            while at < len(data):
                head, _, rest = data[at:].partition(b"\r\n\r\n")
                fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                block = rest[: int(fields["Content-Length"])]
                want.append((at, fields["WARC-Record-ID"], fields.get("WARC-Target-URI"), block.partition(b"\r\n\r\n")[2]))
                at += len(head) + 4 + len(block) + 4
        got = warc.read_warc(spark, path, width=width).collect()
        assert len(got) == len(PAGES)
        assert sorted(map(repr, want)) == sorted(
            repr((r["start"], r["headers"]["warc-record-id"], r["headers"].get("warc-target-uri"), bytes(r["payload"]))) for r in got
        )
        assert all("x" not in r["headers"] for r in got)

    def test_damage_is_found(self, spark, pages, tmp_path):
        path = f"file://{tmp_path}/w"
        warc.write_warc(pages.coalesce(1), path)
        file = next((tmp_path / "w").glob("part-*"))
        whole = file.read_bytes()
        second = whole.index(b"\r\n\r\nWARC/1.0", 10) + 4
        for crc in (tmp_path / "w").glob(".*.crc"):
            crc.unlink()
        file.write_bytes(whole[: second + 5] + b"?" + whole[second + 6 :])
        with pytest.raises(ValueError, match="breaks off"):
            warc.read_warc(spark, path)
        assert warc.read_warc(spark, path, strict=False).count() == 1
        file.write_bytes(whole[:-1000])
        with pytest.raises(ValueError, match="breaks off"):
            warc.read_warc(spark, path)
        file.write_bytes(b"\r\n" + whole)
        with pytest.raises(ValueError, match="breaks off"):
            warc.read_warc(spark, path)

    def test_other_writers(self, spark, tmp_path):
        record = b"WARC/1.1\r\nwarc-type:metadata\r\nX-Note: a\r\n  folded\r\nContent-Type: text/plain\r\nCONTENT-LENGTH: 4\r\n\r\n\x00\xff\r\n\r\n\r\n"
        (tmp_path / "x.warc").write_bytes(record * 40)
        rows = warc.read_warc(spark, f"file://{tmp_path}", width=64).collect()
        assert sorted(r["start"] for r in rows) == [k * len(record) for k in range(40)]
        assert {(r["headers"]["x-note"], bytes(r["payload"])) for r in rows} == {("a folded", b"\x00\xff\r\n")}

    def test_least_bytes(self, pages):
        assert {r["record_type"] for r in warc.page_report(pages, least_bytes=10**6).collect()} == {"response"}

    def test_empty(self, spark, pages):
        assert warc.page_report(pages.limit(0)).collect() == []


def plain_runs(w):
    """Start, length and period of all runs, from the definition: each period by itself."""
    w, best = np.asarray(w), {}
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate(([0], (w[:-q] == w[q:]).astype(np.int8), [0]))
        for a, b in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist()):
            if b - a + q >= max(6, 4 * q):
                best.setdefault((a, b + q), q)
    return sorted((a, b - a, q) for (a, b), q in best.items())


class TestPeriodicRuns:
    def test_random_texts(self):
        rng = random.Random(13)
        for _ in range(600):
            docs = []
            for _ in range(rng.randint(0, 5)):
                k = rng.choice([1, 2, 3, 6])
                w = [rng.randrange(k) for _ in range(rng.randint(0, 30))]
                unit = [rng.randrange(k) for _ in range(rng.randint(1, 7))]
                w += unit * rng.randint(0, 9) + unit[: rng.randint(0, 3)] + w[:5]
                docs.append(w * rng.choice([1, 1, 1, 5]))
            edges = np.cumsum([0, *map(len, docs)]).astype(np.int64)
            got = periodic_runs.runs(np.array([x for d in docs for x in d], np.int64), edges)
            own = [[tuple(r) for r in x.tolist()] for x in periodic_runs._lists(edges, got)]
            assert own == [plain_runs(d) for d in docs]

    @pytest.mark.parametrize("words, want", [
        ([0] * 50_000, [(0, 50_000, 1)]),
        ([k % 1000 for k in range(50_000)], [(0, 50_000, 1000)]),
        ([x for k in range(5000) for x in (k + 5, 1, 1, 1, 1, 1, 1)], [(7 * k + 1, 6, 1) for k in range(5000)]),
    ])
    def test_long_texts(self, words, want):
        got = periodic_runs.runs(np.array(words, np.int64), np.array([0, len(words)]))
        assert [(a, b - a, q) for a, b, q in got.tolist()] == want

    @staticmethod
    def brute(i, text):
        w = (text or "").encode().split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        number = {x: k for k, x in enumerate(dict.fromkeys(w))}
        found = plain_runs([number[x] for x in w])
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        gone = {k for s, size, q in found for k in range(s + q, s + size)}
        return (
            i, len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest(),
        )

    @pytest.mark.parametrize("table", ["docs", "odd_docs"])
    def test_report(self, request, table):
        df = request.getfixturevalue(table)
        plain = functools.cache(self.brute)
        want = sorted(repr(plain(r["doc_id"], r["text"])) for r in df.select("doc_id", "text").collect())
        assert sorted(repr(tuple(r)) for r in periodic_runs.run_report(df).collect()) == want

    def test_repeats_in_texts(self, spark, no_docs):
        rows = [(1, "say  ha ha\tha ha ha ha now"), (2, "A a A a A a A a A a"), (3, "a b c d"), (4, None), (5, " \n "), (None, "x\x1cy " * 6)]
        out = periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in out} == {
            1: ([(1, 6, 1)], "say ha now"), 2: ([(0, 10, 2)], "A a"), 3: ([], "a b c d"), 4: ([], ""), 5: ([], ""), None: ([(0, 6, 1)], "x\x1cy"),
        }
        assert periodic_runs.periodic_runs(no_docs).collect() == periodic_runs.run_report(no_docs).collect() == []
