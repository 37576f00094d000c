"""Operators that relate documents to each other, against brute force."""

import collections
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tidewater.llm import line_dedup, mixing, near_dedup, packing, queries, sharding, tokens
from tidewater.llm.components import components
from tidewater.llm.tokens import piece_encoder


def columns_kept(out, docs):
    assert out.columns == docs.columns
    assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


class TestLineDedup:
    @classmethod
    def brute(cls, docs, min_docs, similarity, passages=False, near=None):
        least = lambda tokens: line_dedup.LONG_MIN_DOCS if len(tokens) >= line_dedup.LONG else min_docs

        texts = collections.defaultdict(list)
        for i, t in docs:
            if t is not None:
                texts[t].append((i is None, 0 if i is None else i))
        first = {t: min(v) for t, v in texts.items()}
        lines = {}
        for t in texts:
            for n, line in enumerate(t.split("\n")):
                tokens = tuple("<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line))
                if tokens:
                    lines[t, n] = tokens

        def recurring(keys):
            by = collections.defaultdict(set)
            for (t, _), k in keys.items():
                by[k].add(t)
            tokens = lambda k: k[1] if isinstance(k[0], tuple) else k
            return {k: min(v, key=first.__getitem__) for k, v in by.items() if len(v) >= least(tokens(k))}

        exact = recurring(lines)
        leaf = {k: (len(v), v[: line_dedup.DEPTH]) for k, v in lines.items()}
        busy = collections.defaultdict(set)
        for (t, n), k in leaf.items():
            busy[k].add(t)
        left = {k: v for k, v in lines.items() if len(busy[leaf[k]]) >= least(v) and v not in exact}
        seen = collections.defaultdict(set)
        for k, v in left.items():
            for p, w in enumerate(v):
                if w != "<*>":
                    seen[leaf[k], p, w].add(k[0])
        general = set()
        for level in range(40):  # the number of texts that makes a token constant doubles
            masked = {}
            for k, v in left.items():
                enough = least(v) * 2**level
                m = tuple(w if len(seen[leaf[k], p, w]) >= enough else "<*>" for p, w in enumerate(v))
                if sum(w != "<*>" for w in m) >= similarity * sum(w != "<*>" for w in v) and any(w != "<*>" for w in m):
                    masked[k] = (leaf[k], m)
            found = recurring(masked)
            found = {(k, found[v]) for k, v in masked.items() if found.get(v, k[0]) != k[0]}
            general |= found
        lost = {(k, exact[v]) for k, v in lines.items() if exact.get(v, k[0]) != k[0]} | general
        if passages:
            lost |= cls.passages(texts, first)
        if near is not None:
            by_text = collections.defaultdict(set)
            for (t, n), keeper in lost:
                by_text[t, keeper].add(n)
            sets = TestNearDedup.sets([(t, t.lower()) for t in texts])
            size = lambda line: len(" ".join(re.findall(r"[^\x20\x09-\x0D]+", line)).encode())
            for (t, keeper), numbers in by_text.items():
                own, other = t.split("\n"), len(sets[t] & sets[keeper])
                whole = len("\n".join(re.sub("[ \t\x0b\x0c\r]+", " ", x) for x in own).encode())
                if 2 * sum(size(own[n]) for n in numbers) >= whole and 100 * other >= near * len(sets[t] | sets[keeper]):
                    lost -= {((t, n), keeper) for n in numbers}
        drop = {k for k, _ in lost}
        return {t: "\n".join(x for n, x in enumerate(t.split("\n")) if (t, n) not in drop) for t in texts}

    @staticmethod
    def passages(texts, first):
        """Lines of runs of LONG tokens, the shortest from or up to a line, that an earlier text has, and that text."""
        seen = collections.defaultdict(list)
        for t in texts:
            lines = [(n, tuple(re.findall(r"[^\x20\x09-\x0D]+", x))) for n, x in enumerate(t.split("\n"))]
            lines = [(n, w) for n, w in lines if w]
            ends = np.cumsum([len(w) for _, w in lines]).tolist()
            starts = [e - len(w) for e, (_, w) in zip(ends, lines)]
            for k in range(len(lines)):
                after = [j for j in range(k, len(lines)) if starts[j] - starts[k] < line_dedup.LONG]
                before = [j for j in range(k + 1) if ends[k] - ends[j] < line_dedup.LONG]
                for run in (after, before):
                    if sum(len(lines[j][1]) for j in run) >= line_dedup.LONG:
                        seen[tuple(lines[j][1] for j in run)].append((t, lines[run[0]][0], lines[run[-1]][0]))
        out = set()
        for places in seen.values():
            keeper = min({t for t, _, _ in places}, key=first.__getitem__)
            out |= {((t, n), keeper) for t, a, b in places if t != keeper for n in range(a, b + 1)}
        return out

    def check(self, df, **options):
        docs = [tuple(r) for r in df.select("doc_id", "text").collect()]
        more = {k: v for k, v in options.items() if k != "min_docs"}
        want = self.brute(docs, options.get("min_docs", line_dedup.MIN_DOCS), line_dedup.SIMILARITY, **more)
        out = line_dedup.drop_recurring_lines(df, **options)
        columns_kept(out, df)
        got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
        assert got == sorted(((i, None if t is None else want[t]) for i, t in docs), key=repr)

    @pytest.mark.parametrize("options", [{}, {"passages": True, "near": 70}])
    def test_whole_table(self, docs, options):
        self.check(docs, **options)

    @pytest.mark.parametrize("lines", [10, 1])
    def test_near_copies_stay_whole(self, spark, lines):
        word = lambda k: "".join(chr(97 + int(d)) for d in str(k))
        shared = [" ".join(f"s{word(k)}w{word(j)}" for j in range(120 // lines)) for k in range(lines)]
        rows = [(i, ("\n" if lines > 1 else " ").join([*shared, f"only {word(i)} has this last line"])) for i in range(12)]
        rows += [(100 + i, f"{shared[0] if lines > 1 else 'Posted on the board at noon with love by'}\n" + " ".join(f"own{word(i)}{word(j)}" for j in range(60))) for i in range(9)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        self.check(df, passages=True, near=70)
        out = line_dedup.drop_recurring_lines(df, passages=True, near=70)
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        assert all(got[i] == rows[i][1] for i in range(12))  # copies lose nothing to one another
        assert sum("\n" in got[100 + i] for i in range(9)) == (0 if lines > 1 else 1)  # others lose what recurs
        left = near_dedup.drop_near_duplicates(out, percent=80)
        assert sorted(r["doc_id"] for r in left.collect()) == [0, *range(100, 109)]

    def test_templates(self, spark):
        r = random.Random(3)
        rows = []
        for i in range(80):
            lines = [
                f"Posted by {r.choice('ann bob cid dan eve fay'.split())}{r.choice('uvwxyz')} on the board at {r.randrange(999)} today with love",
                f"Page {i} of 20", "", " ".join(r.choice(["red", "blue", "tea", "sun"]) + r.choice("abcdefgh") for _ in range(12)),
            ]
            r.shuffle(lines)
            rows.append((i if i % 17 else None, "\n".join(lines)))
        df = spark.createDataFrame([*rows, *rows[:5]], "doc_id long, text string")
        self.check(df)
        texts = [r["text"] for r in line_dedup.drop_recurring_lines(df).dropDuplicates(["text"]).collect()]
        assert sum("Posted by" in t for t in texts) == 1 and sum("Page" in t for t in texts) == 1

    def test_copies_keep_their_lines(self, spark):
        df = spark.createDataFrame([(i, "one line here\nand another there") for i in range(50)], "doc_id long, text string")
        assert {r["text"] for r in line_dedup.drop_recurring_lines(df).collect()} == {"one line here\nand another there"}

    def test_templates_of_a_large_leaf(self, spark):
        word = lambda k: "".join(chr(97 + int(d)) for d in str(k))
        rows = []
        for i in range(600):
            k = word(i % 30)
            rows.append((i, f"{word(i)} alone\n2024-01-{i % 28} 10:{i % 60} task{k} by{k} user {word(7000 + i)} ended{k} well{k} now{k}"))
        # 30 templates of 20 texts in one leaf
        df = spark.createDataFrame(rows, "doc_id long, text string")
        texts = [r["text"] for r in line_dedup.drop_recurring_lines(df).collect()]
        assert sum("user" in t for t in texts) == 30 and all(" alone" in t for t in texts)
        assert {t.split()[-1] for t in texts if "user" in t} == {f"now{word(k)}" for k in range(30)}

    @pytest.mark.parametrize("others", [0, 100, 2000])
    def test_other_texts_in_the_leaf_change_nothing(self, spark, others):
        word = lambda k: "".join(chr(97 + int(d)) for d in str(k))
        rows = [(i, f"Posted by {word(i)} on the board at noon with love\nown {word(i)}") for i in range(10)]
        rows += [(10 + i, "Posted by " + " ".join(f"{word(i)}{c}" for c in "ghijklmn")) for i in range(others)]
        out = line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sum("board" in r["text"] for r in out) == 1 and all(r["text"] == rows[r["doc_id"]][1] for r in out if r["doc_id"] >= 10)

    def test_copies_lose_the_same_lines(self, spark):
        word = lambda k: "".join(chr(97 + int(d)) for d in str(k))
        rows = [(i, f"Posted by {word(i)} on the board at noon with love\nown {word(i)}") for i in range(10)]
        df = spark.createDataFrame([*rows, *((100 + i, t) for i, t in rows), (None, rows[3][1])], "doc_id long, text string")
        self.check(df)
        out = line_dedup.drop_recurring_lines(df).collect()
        assert sorted(r["text"] for r in out if "board" in r["text"]) == [rows[0][1]] * 2

    def test_a_very_long_line(self, spark):
        line = " ".join(f"w{chr(97 + k % 26)}{k % 977}x" if k % 3 else f"v{chr(97 + k % 19)}" for k in range(100_000))
        df = spark.createDataFrame([(i, f"{line} {chr(97 + i)}") for i in range(9)], "doc_id long, text string")
        begin = time.monotonic()
        assert sum(len(r["text"]) > 0 for r in line_dedup.drop_recurring_lines(df).collect()) in (1, 9)
        assert time.monotonic() - begin < 120

    def test_digit_fields_are_no_difference(self, spark):
        word = lambda k: "".join(chr(97 + int(d)) for d in str(k))
        rows = [(i, f"about {word(i)}\nLogin by user {word(i)} from host 10.0.0.{i} at 10:{i} status {i}") for i in range(40)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        texts = [r["text"] for r in line_dedup.drop_recurring_lines(df).collect()]
        assert sum("Login" in t for t in texts) == 1

    def test_rows_of_figures_are_no_template(self, spark):
        rows = [(i, f"about {chr(97 + i)}\n{2000 + i} {i * 7} {i + 3}\nRevenue {i * 11} {i} {i + 1}\nsame 1 2 3") for i in range(12)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring_lines(df).collect()}
        assert got == {i: t if i == 0 else t.removesuffix("\nsame 1 2 3") for i, t in rows}

    def test_passages_of_two_texts(self, spark):
        words = [f"p{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
        wrapped = "\n".join([" ".join(words[:25]), "", " ".join(words[25:50]), " ".join(words[50:])])
        rows = [(0, f"one\n{wrapped}\nend"), (1, f"two\n{wrapped}\nlast"), (2, f"three\n{' '.join(words)}"), (3, f"four\n{' '.join(words)}")]
        rows += [(4, f"five\n{' '.join(words[:25])}"), rows[1], (None, rows[1][1])]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.drop_recurring_lines(df, passages=True).collect()), key=repr)
        cut = "two\nlast"
        assert got == sorted([rows[0], (1, cut), (1, cut), (None, cut), rows[2], (3, "four"), rows[4]], key=repr)

    def test_long_passages_need_fewer_texts(self, spark):
        passage = " ".join(f"p{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
        rows = [(i, f"own words {'abc'[i]}\n{passage}\nshort one") for i in range(3)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        self.check(df)
        got = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring_lines(df).collect()}
        assert got == {0: rows[0][1], 1: "own words b\nshort one", 2: "own words c\nshort one"}

    def test_odd_rows(self, odd_docs, no_docs):
        self.check(odd_docs)
        self.check(odd_docs, min_docs=2)
        self.check(odd_docs, min_docs=2, passages=True, near=70)
        assert line_dedup.line_report(no_docs).count() == 0
        report = line_dedup.line_report(odd_docs, min_docs=2).collect()
        assert len(report) == odd_docs.count() and all(0 <= r["n_dropped"] <= r["n_lines"] for r in report)

    def test_native(self, docs):
        plan = line_dedup.drop_recurring_lines(docs, passages=True, near=70)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


class TestNearDedup:
    @staticmethod
    def sets(docs):
        out = {}
        for i, t in docs:
            w = (t or "").encode().lower().split()
            out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
        return out

    @classmethod
    def roots(cls, rows, percent=near_dedup.PERCENT):
        """The set of each id, and the smallest id that it is linked with."""
        sets = cls.sets(rows)
        root = {i: i for i in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        ids = sorted(i for i in sets if sets[i])
        for k, i in enumerate(ids):
            for j in ids[:k]:
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        return sets, {i: find(i) for i in sets}

    def check(self, df):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect() if r["doc_id"] is not None]
        sets, root = self.roots(rows)
        got = [r for r in near_dedup.near_duplicates(df).collect() if r["doc_id"] is not None]
        assert len(got) == len(rows)
        for r in got:
            i = r["doc_id"]
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), root[i], root[i] == i), i

    def test_whole_table(self, docs):
        self.check(docs)

    @pytest.mark.parametrize("group", [4, 256])
    def test_a_large_group_near_the_threshold(self, spark, monkeypatch, group):
        monkeypatch.setattr(near_dedup, "_GROUP", group)
        monkeypatch.setattr(near_dedup, "_BLOCK", 16)
        r = random.Random(5)
        base = [f"w{k}" for k in range(200)]
        rows = []
        for i in range(90):
            words = list(base)
            for _ in range(r.randint(1, 6)):
                words[r.randrange(200)] = f"x{r.randrange(10**6)}"
            rows.append((i, " ".join(words)))
        self.check(spark.createDataFrame(rows, "doc_id long, text string"))

    def test_pairs_of_a_busy_set_are_dealt(self, spark, monkeypatch):
        monkeypatch.setattr(near_dedup, "_GROUP", 10)
        star = [(0, i) for i in range(1, 600)]  # the busy end comes first
        other = [(i, 10_000) for i in range(600, 900)]  # or last
        lone = [(i, i + 1) for i in range(1_000, 1_050, 2)]
        df = spark.createDataFrame(star + other + lone, "a long, b long")
        got = [tuple(r) for r in near_dedup._dealt(df, lambda table, label: table).collect()]
        assert {frozenset(r[:2]) for r in got} == {frozenset(p) for p in star + other + lone} and len(got) == len(star + other + lone)
        groups = collections.Counter((a, part) for a, _, part in got)
        assert max(groups.values()) < 30 and {a for a, _, _ in got if a in (0, 10_000)} == {0, 10_000}
        assert max(collections.Counter(b for _, b, _ in got).values()) == 1

    @pytest.mark.parametrize("hot", [10, 10_000])
    def test_many_texts_on_one_template(self, spark, monkeypatch, hot):
        monkeypatch.setattr(near_dedup, "_BLOCK", 8)
        monkeypatch.setattr(near_dedup, "_HOT", hot)
        r = random.Random(6)
        base = [f"w{k}" for k in range(150)]
        rows = [(0, " ".join(base)), (1, " ".join(base[:140])), (2, " ".join(base[:120]))]
        for i in range(3, 120):  # from alike in half of all shingles to alike in nearly all
            own = [f"x{i}y{k}" for k in range(r.choice([1, 5, 12, 20, 26, 27, 40, 80]))]
            rows.append((i, " ".join(base[: r.choice([150, 150, 145, 135])] + own)))
        for i in range(120, 150):  # and near copies of these
            words = rows[r.randrange(3, 120)][1].split()
            rows.append((i, " ".join(words[: len(words) - r.randint(0, 6)])))
        self.check(spark.createDataFrame(rows, "doc_id long, text string"))

    def test_texts_with_enough_of_their_own_meet_in_no_shingle(self, spark):
        own = lambda i, n: np.array([*range(240), *range(1000 * (i + 1), 1000 * (i + 1) + n)], np.int64).tobytes()
        sets = [(i, own(i, 60)) for i in range(60)] + [(60, own(0, 50))]  # 240 shared of 360, but for the last
        df = spark.createDataFrame(sets, "id long, set binary")
        found = near_dedup._rare_shingles(df, 85, lambda table, label: table).groupBy("key").agg(F.collect_set("id").alias("ids"))
        assert {tuple(sorted(r["ids"])) for r in found.collect() if len(r["ids"]) > 1} == {(0, 60)}

    def test_the_stage_links_from_80_percent(self, spark, sf_dir):
        import corpus_pipeline

        rows = []
        for i in range(60):
            base = [f"d{i}w{k}" for k in range(200)]
            other = list(base)
            for k in (20, 60, 100, 140):
                other[k] = f"d{i}x{k}"
            rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]  # 176 shingles of 216: 0.815
        df = spark.createDataFrame(rows, "doc_id long, text string")
        out = corpus_pipeline.near_dedup(spark, df, sf_dir)
        assert sorted(r["doc_id"] for r in out.collect()) == list(range(0, 120, 2))
        assert near_dedup.near_duplicates(df).where("kept").count() == 120

    def test_odd_rows(self, odd_docs, no_docs):
        self.check(odd_docs)
        assert near_dedup.near_duplicates(no_docs).count() == 0
        out = near_dedup.drop_near_duplicates(odd_docs)
        columns_kept(out, odd_docs)
        kept = {r["doc_id"] for r in near_dedup.near_duplicates(odd_docs).where("kept").collect()}
        left = [r["doc_id"] for r in out.collect()]
        assert set(left) == kept and len([i for i in left if i is not None]) == len(kept - {None})
        assert left.count(None) == odd_docs.where("doc_id is null").count()

    def test_rows_that_share_an_id_or_have_none(self, spark):
        text = lambda name: " ".join(f"{name}{k}" for k in range(40))
        rows = [
            (1, text("a")), (2, text("a").upper()), (2, text("b")), (3, text("b") + " more"), (4, text("c")), (4, text("c")),
            (5, text("d")), (5, text("e")), (6, text("f")), (6, text("f") + " more"), (7, None), (7, None), (7, ""),
            (None, text("g")), (None, text("g")), (None, text("h")), (None, None), (None, text("a")),
        ]
        out = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        got = [tuple(r) for r in out.collect()]
        of_six = [r for r in got if r[0] == 6]
        assert len(of_six) == 1 and of_six[0] in rows
        want = [rows[k] for k in (0, 2, 4, 6, 7, 10, 12, 13, 14, 15, 16)]
        assert sorted((r for r in got if r[0] != 6), key=repr) == sorted(want, key=repr)

    def test_pairs_just_above_the_threshold(self, spark):
        rows = []
        for i in range(300):
            n = 60 + 3 * i  # shingles of a text of n + 4 words; one word in the middle replaced changes five of them
            words = [f"d{i}w{k}" for k in range(n + 4)]
            other = list(words)
            for k in range(max(1, int(n * 0.08 / 5))):
                other[8 + k * 10] = f"d{i}x{k}"
            rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        sets = self.sets(rows)
        share = [len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) for i in range(300)]
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df).collect()}
        assert sum(0.85 <= x < 0.88 for x in share) > 200
        assert all((got[2 * i + 1] == 2 * i) == (x >= 0.85) for i, x in enumerate(share))

    def test_components(self, spark):
        r = random.Random(1)
        links = [(k, k + 1) for k in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)]
        root = {x: x for p in links for x in p}
        changed = True
        while changed:
            changed = False
            for a, b in links:
                low = min(root[a], root[b])
                changed |= root[a] != low or root[b] != low
                root[a] = root[b] = low
        got = {x["id"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == root


class TestPacking:
    def test_solver(self):
        r = random.Random(2)
        for trial in range(120):
            capacity = r.choice([10, 20, 50, 4096])
            sizes = collections.Counter(r.randint(1, capacity) for _ in range(r.randint(0, 200)))
            runs, bins, fixed = packing.solve(dict(sizes), capacity)
            content, ranks = collections.defaultdict(list), collections.defaultdict(list)
            for run in runs:
                ranks[run.size] += range(run.low, run.high)
                for k in range(run.high - run.low):
                    content[run.bin + k // run.per].append((run.offset + k % run.per * run.size, run.size))
            assert {s: sorted(v) for s, v in ranks.items()} == {s: list(range(n)) for s, n in sizes.items()}
            assert sorted(content) == list(range(bins)) and 0 <= fixed <= bins
            for items in content.values():
                end = 0
                for place, size in sorted(items):
                    assert place == end
                    end += size
                assert end <= capacity

    def test_reduction_is_optimal_where_it_ends(self):
        from functools import lru_cache

        def best(items, capacity):
            items = sorted(items, reverse=True)

            @lru_cache(None)
            def go(k, rooms):
                if k == len(items):
                    return 0
                options = {go(k + 1, tuple(sorted((*rooms[:j], room - items[k], *rooms[j + 1 :])))) for j, room in enumerate(rooms) if room >= items[k]}
                return min([*options, 1 + go(k + 1, tuple(sorted((*rooms, capacity - items[k]))))])

            return go(0, ())

        r = random.Random(8)
        ended = 0
        for _ in range(150):
            items = [r.randint(3, 20) for _ in range(r.randint(1, 8))]
            _, bins, fixed = packing.solve(dict(collections.Counter(items)), 20)
            assert bins >= best(tuple(items), 20)
            if fixed == bins:
                ended += 1
                assert bins == best(tuple(items), 20)
        assert ended > 50

    @pytest.mark.parametrize("which", ["docs", "odd_docs"])
    def test_pieces_and_sequences(self, request, which):
        from tokenizers import Tokenizer

        df = request.getfixturevalue(which)
        tokenizer = Tokenizer.from_file(queries.tokenizer_file())
        want = []
        for r in df.collect():
            ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]
            for k in range(0, len(ids), 4096):
                piece = ids[k : k + 4096]
                want.append((r["doc_id"], k // 4096, k, len(piece), zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))))
        rows = packing.pack_documents(df, queries.tokenizer_file()).collect()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in rows)
        by = collections.defaultdict(list)
        for r in rows:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for items in by.values():
            end = 0
            for place, size in sorted(items):
                assert place == end
                end += size
            assert end <= 4096
        assert len(by) <= 1.02 * -(-sum(r["length"] for r in rows) // 4096) + 1

    def test_texts_without_gaps(self, monkeypatch):
        from tokenizers import Tokenizer

        r = random.Random(6)
        texts = ["".join(r.choice("abé12!?''\u00bdstrev\u00aa") for _ in range(400)) for _ in range(60)] + ["a" * 500, "'" * 500, "x'" * 200, "''s" * 150, "!s" * 200]
        tokenizer = Tokenizer.from_file(queries.tokenizer_file())
        monkeypatch.setattr(tokens, "_PART", 20)
        encode = piece_encoder.__wrapped__(queries.tokenizer_file())
        assert [b.tolist() for b in encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    def test_long_words_have_one_hash(self, monkeypatch):
        import pyarrow as pa

        from tidewater.llm import shingles

        r = random.Random(9)
        texts = ["".join(r.choice("aBc é \n") for _ in range(r.randint(0, 300))) for _ in range(40)] + [None, "", "x" * 1000, "y " * 30, " " + "z" * 65]
        column = pa.array(texts)
        words, at = shingles.word_hashes(column)
        assert np.diff(at).tolist() == [len((t or "").encode().split()) for t in texts]
        for block, scan in ((64, 7), (16, 1000)):
            monkeypatch.setattr(shingles, "_BLOCK", block)
            monkeypatch.setattr(shingles, "_SCAN", scan)
            again, place = shingles.word_hashes(column)
            assert (again == words).all() and (place == at).all()
        assert (shingles.word_hashes(pa.array([None, "a", "b c"])[1:])[0] == shingles.word_hashes(pa.array(["A", "B C"]))[0]).all()

    def test_encoder(self, monkeypatch):
        from tokenizers import Tokenizer

        r = random.Random(1)
        texts = ["", None, "it's THEY'RE <|endoftext|>", "Σίσυφος ΣΑΣ İ", "é É", *("a" + chr(c) + "b " + chr(c) + "1" for c in range(1, 0x180))]
        texts += ["".join(chr(r.choice([r.randrange(1, 0x180), r.randrange(32, 127)])) for _ in range(100)) for _ in range(300)]
        tokenizer = Tokenizer.from_file(queries.tokenizer_file())
        encode = piece_encoder(queries.tokenizer_file())
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [b.tolist() for b in encode(texts)] == want
        monkeypatch.setattr(tokens, "_PART", 50)  # texts in parts, batches of few parts
        monkeypatch.setattr(tokens, "_KEPT", 100)  # pieces forgotten and met again
        assert [b.tolist() for b in encode([*texts, " ".join(t or "" for t in texts[:80])])][:-1] == want

    def test_pieces(self):
        pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        r = random.Random(4)
        for _ in range(3000):
            text = "".join(r.choice("strevmlld''. é1½ \n") for _ in range(r.randint(0, 14)))
            starts, ends = tokens.piece_bounds(np.frombuffer(text.encode("utf-16-le"), np.uint16))
            assert [text[a:b] for a, b in zip(starts, ends)] == pattern.findall(text), text

    def test_empty(self, no_docs):
        assert packing.pack_documents(no_docs, queries.tokenizer_file()).count() == 0


class TestSharding:
    @pytest.mark.parametrize("which", ["docs", "odd_docs"])
    def test_shards(self, request, which):
        df = request.getfixturevalue(which)
        rows = sharding.kd_shards(df).collect()
        want = sorted(repr((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode()))) for r in df.collect())
        assert sorted(repr((r["doc_id"], r["size"], r["text_crc32"])) for r in rows) == want
        slots, weight = collections.defaultdict(list), collections.Counter()
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            weight[r["shard"]] += r["size"]
        assert set(slots) <= set(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
        mean, largest = sum(weight.values()) / 24, max(r["size"] for r in rows)
        assert all(abs(weight[k] - mean) <= 2.5 * largest for k in range(24))

    def test_cuts_are_weighted_medians_of_the_widest_dimension(self, docs):
        """Each node of the tree, found again from the shards, against a plain sort of its rows."""
        shard = {r["doc_id"]: r["shard"] for r in sharding.kd_shards(docs).collect()}
        rows = [r.asDict() for r in sharding.metadata(docs).collect()]
        top, texts = (1 << 20) - 1, collections.Counter()
        for r in rows:
            texts[r["_tb"]] += r["size"]

        def walk(first, k):
            own = [r for r in rows if first <= shard[r["doc_id"]] < first + k]
            if k == 1 or not own:
                return
            spans = {d: (min(r[d] for r in own), max(r[d] for r in own)) for d in sharding.DIMENSIONS}
            d = max(sharding.DIMENSIONS, key=lambda d: spans[d][1] - spans[d][0])
            low, high = spans[d]

            def place(r):
                return int((r[d] - low) / max(high - low, 1e-12) * top), r["_tb"], r["_ib"]

            left = [r for r in own if shard[r["doc_id"]] < first + k // 2]
            right = [r for r in own if shard[r["doc_id"]] >= first + k // 2]
            if left and right:
                assert max(map(place, left)) < min(map(place, right))
            total = sum(r["size"] for r in own)
            slack = max(max(r["size"] for r in own), 20 * sharding.TOLERANCE * total / k, max(texts[r["_tb"]] for r in own))
            assert abs(sum(r["size"] for r in left) - total * (k // 2) / k) <= slack
            walk(first, k // 2)
            walk(first + k // 2, k - k // 2)

        walk(0, 24)

    def test_a_hot_text_and_many_slots(self, spark, monkeypatch):
        monkeypatch.setattr(sharding, "GROUP_ROWS", 10)
        rows = [(i, "the same text" if i % 3 else f"text number {i}", "en") for i in range(600)]
        out = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string"), shards=5).collect()
        sizes, slots = collections.Counter(), collections.defaultdict(list)
        for r in out:
            sizes[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert len(out) == 600 and max(sizes.values()) < 1.25 * min(sizes.values())
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())

    def test_empty_and_native(self, no_docs, docs):
        assert sharding.kd_shards(no_docs).count() == 0
        assert not re.search("Python|Pandas|Arrow", sharding.kd_shards(docs)._jdf.queryExecution().executedPlan().toString())


class TestMixing:
    @staticmethod
    def targets(sizes, share, cap):
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
        left, free, out = share * sum(sizes.values()), set(names), {}
        while free:
            total = sum(weight[s] for s in free)
            over = [s for s in free if left * weight[s] / total > cap * sizes[s] + 1e-9]
            for s in over or free:
                out[s] = cap * sizes[s] if over else left * weight[s] / total
            left -= sum(out[s] for s in over)
            free -= set(over) if over else free
        return out

    @pytest.mark.parametrize("share", [0.3, 1.5, 1.9, 5.0])
    @pytest.mark.parametrize("which", ["docs", "odd_docs"])
    def test_mix(self, request, which, share):
        df = request.getfixturevalue(which)
        rows = mixing.mix(df, share=share, bucket_rows=10).collect()
        words = lambda t: len((t or "").encode().split())
        want = sorted(repr((r["doc_id"], words(r["text"]))) for r in df.collect())
        assert sorted(repr((r["doc_id"], r["size"])) for r in rows) == want
        sizes, taken, target = collections.Counter(), collections.Counter(), {}
        for r in rows:
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
            assert 0 <= r["taken"] <= 2 * r["size"]
        for s, t in self.targets(sizes, share, 2.0).items():
            assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 1
        assert sorted(map(repr, mixing.mix(df, share=share, bucket_rows=10).collect())) == sorted(map(repr, rows))

    def test_documents(self, odd_docs, docs, no_docs):
        for df in (docs, odd_docs):
            out = mixing.mixed_documents(df)
            columns_kept(out, df)
            words = F.sum(mixing.word_count(F.col("text")))
            want = {r["source"]: r["target"] for r in mixing.mix(df).collect()}
            longest = max(len((r["text"] or "").split()) for r in df.collect())
            for r in out.groupBy("source").agg(words.alias("n")).collect():
                assert abs(r["n"] - want[r["source"]]) <= 2 * longest
        assert mixing.mixed_documents(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0

    @pytest.mark.parametrize("share", [0.25, 1.5])
    def test_a_cut_through_equal_rows(self, spark, share):
        row = (7, "ten words of a text that stands here many times", "src", 1)
        rows = [row] * 200 + [(k, f"another text of six words {k}", s, 2) for k in range(40) for s in ("src", "other", None)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, __s int").repartition(7)
        out = mixing.mixed_documents(df, share=share)
        columns_kept(out, df)
        got = collections.Counter(map(tuple, out.collect()))
        assert set(got) <= set(rows) and all(n <= 2 * rows.count(r) for r, n in got.items())
        taken = collections.Counter()
        for (_, text, source, _), n in got.items():
            taken[source] += n * len(text.split())
        for source, target in {r["source"]: r["target"] for r in mixing.mix(df, share=share).collect()}.items():
            assert target <= taken[source] + 1 and taken[source] <= target + 11

    def test_native(self, docs):
        assert not re.search("Python|Pandas|Arrow", mixing.mix(docs)._jdf.queryExecution().executedPlan().toString())
