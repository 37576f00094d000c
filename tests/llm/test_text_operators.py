"""Operators that look at one text at a time, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import fingerprints, html_blocks, html_extraction, quality_model, quality_rules, toxicity
from tidewater.llm.labelled import held_out, labelled_sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")
HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if HAS_WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


class TestQualityRules:
    @pytest.mark.parametrize("which", ["docs", "odd_docs"])
    def test_counts(self, request, which):
        docs = request.getfixturevalue(which)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        got = by_row(quality_rules.quality_rules(docs), "doc_id", *names, "base_failed")
        want = []
        for r in docs.collect():
            c = counts(r["text"])
            want.append((r["doc_id"], *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
        assert got == sorted(want, key=repr)

    def test_no_python_and_no_exchange(self, docs):
        plan = quality_rules.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Exchange", plan)

    def test_verdict_agrees_with_labels(self, docs, labels):
        rows = quality_rules.quality_rules(docs).join(labels, "doc_id").where("n_words >= 20").collect()
        assert np.mean([r["kept"] == bool(r["quality"]) for r in rows]) > 0.95

    def test_scripts_without_spaces(self, spark):
        chinese = "。 ".join("今天天气很好孩子们在公园里玩了很久然后回家吃饭" + chr(0x4E00 + 7 * k) for k in range(60))
        thai = " ".join("วันนี้อากาศดีเด็กๆเล่นในสวนสาธารณะ" + chr(0x0E01 + k % 40) + chr(0x0E01 + k // 40) for k in range(60))
        joined = " ".join("thewordsofthistextarenotapart" + chr(97 + k % 26) for k in range(60))
        df = spark.createDataFrame(list(enumerate([chinese, thai, joined])), "doc_id long, text string")
        out = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(df).collect()}
        assert out == {0: True, 1: True, 2: False}

    def test_scripts_and_capitals(self, spark):
        russian = "погода сегодня была хорошая поэтому дети гуляли около старого парка вместе".split()
        greek = "ο καιρός ήταν καλός και τα παιδιά έπαιζαν στο πάρκο μέχρι αργά".split()
        capitals = "THE WEATHER WAS GOOD AND MANY CHILDREN PLAYED IN OLD PARKS UNTIL DARK".split()
        polish = "pogoda była ładna więc dzieci bawiły się długo przez cały wieczór razem".split()
        junk = "zorp blit quam frex".split()
        rows = []
        for n, words in enumerate((russian, greek, capitals, polish, junk)):
            rows.append((n, " ".join(f"{words[k % len(words)]}" if k % 3 else f"{words[k % len(words)]}{'жωQżq'[n] * (1 + k)}"[:20] for k in range(60))))
        out = quality_rules.measure(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r["doc_id"]: r["stop_or_long"] for r in out.collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0}

    def test_empty(self, no_docs):
        assert quality_rules.quality_rules(no_docs).count() == 0


class TestToxicity:
    def test_fold(self):
        assert toxicity.fold("Yоu аre an 1d10t_x, i.d.i.o.t $tupid ｌｏｓｅｒ l0ser!! 2024") .split()[:3] == ["you", "are", "an"]
        assert " idiot stupid loser loser 2024 " in toxicity.fold("i.d.i.o.t $tupid ｌｏｓｅｒ l0ser!! 2024")
        assert toxicity.fold("") == toxicity.fold(" \n") == " " or toxicity.fold("").strip() == ""
        assert toxicity.fold("thnd$$$ iner***").split() == ["thnd", "iner"]

    def test_exceptions_and_weights(self):
        m = toxicity.Matcher(toxicity.Model((("clown ", 2.0), ("scum", 3.0)), ("clown fish",)))
        assert m.matches(toxicity.fold("A clown fish.")) == []
        assert [w for _, _, w in m.matches(toxicity.fold("a clown, scummy fish; clown fish"))] == [2.0, 3.0]
        assert m.score("scum scum") > m.score("clown here") > m.score("nothing at all")
        assert 0 <= m.score("") < 0.5

    def test_matches_are_those_of_a_plain_search(self):
        r = random.Random(6)
        word = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 3)))
        for _ in range(400):
            terms = {word() + r.choice(["", " "]): float(k) for k in range(4)}
            phrases = tuple({f"{word()} {word()}" for _ in range(3)})
            text = " " + " ".join(word() for _ in range(r.randint(0, 30))) + " "
            at = lambda x: [k for k in range(len(text)) if text.startswith(x, k)]
            free = [(k, k + len(p) + 2) for p in phrases for k in at(f" {p} ")]
            want = [(k, k + 1 + len(t), w) for t, w in terms.items() for k in at(f" {t}")]
            want = [m for m in want if not any(a <= m[0] and m[1] <= b for a, b in free)]
            found = toxicity.Matcher(toxicity.Model(tuple(terms.items()), phrases)).matches(text)
            assert sorted(found) == sorted(want)

    def test_held_out_documents(self, spark):
        path = "/root/testdata/sf0.1"
        docs, labels = (spark.read.parquet(f"{path}/{name}.parquet") for name in ("documents", "labels"))
        rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
        toxic = [x["predicted"] for x in rows if x["toxic"]]
        clean = [x["predicted"] for x in rows if x["toxic"] == 0]
        assert len(toxic) > 50 and np.mean(toxic) > 0.88 and np.mean(clean) < 0.01

    def test_the_sample_has_all_texts_but_copies(self, spark):
        head = "The same beginning of all these texts, which is longer than forty characters. "
        rows = [(i, head + f"number {i % 20}") for i in range(40)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
        got = labelled_sample(docs, labels, "toxic", 100).collect()
        known = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5}
        assert sorted((r["text"], r["label"]) for r in got) == sorted({(rows[i][1], i % 2) for i in known})

    def test_learned_from_labels_that_are_not_held_out(self, spark):
        clean = [(i, " ".join(f"w{(i * 3 + k) % 50}" for k in range(60)), 0) for i in range(200)]
        bad = [(i, " ".join(f"w{(i * 3 + k) % 50}" for k in range(40)) + f" zarko{i % 7} zarko{i % 5}", 1) for i in range(200, 300)]
        df = spark.createDataFrame([(i, t) for i, t, _ in clean + bad], "doc_id long, text string")
        labels = spark.createDataFrame([(i, 1, y) for i, _, y in clean + bad], "doc_id long, quality int, toxic int")
        out = {r["doc_id"]: r for r in toxicity.toxicity(df, labels).collect()}
        assert all(out[i]["predicted"] == y for i, _, y in clean + bad)
        assert any(r["held_out"] for r in out.values())
        kept = {r["doc_id"] for r in toxicity.drop_toxic(df, labels).collect()}
        assert kept == {i for i, _, y in clean + bad if not y}

    def test_odd_rows(self, odd_docs, no_labels, no_docs):
        out = toxicity.toxicity(odd_docs, no_labels).collect()
        assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in out)
        assert toxicity.toxicity(no_docs, no_labels).count() == 0
        assert toxicity.drop_toxic(odd_docs, no_labels).columns == odd_docs.columns


class TestQualityModel:
    def test_sum_of_squares_identity(self):
        m = quality_model.Machine.new()
        place, value = np.array([1, 5, 9, quality_model.WORDS]), np.array([0.5, 1.0, -2.0, 0.25])
        pairs = sum(m.vectors[place[i]] @ m.vectors[place[j]] * value[i] * value[j] for i in range(4) for j in range(i))
        assert np.isclose(m.raw(place, value)[0], m.bias + m.weights[place] @ value + pairs)
        again = quality_model.Machine.load(m.dump())
        assert np.isclose(again.raw(place, value)[0], m.raw(place, value)[0], atol=1e-5)

    def test_an_interaction_is_learned(self):
        rng = np.random.default_rng(0)
        rows, labels = [], []
        for _ in range(400):
            s = np.zeros(len(quality_model.STATISTICS))
            s[:2] = rng.integers(0, 2, 2) * 2 - 1
            rows.append((np.zeros(0, np.int64), s))
            labels.append(float(s[0] * s[1] > 0))
        m = quality_model.fit(rows, np.array(labels))
        assert np.mean([(m.score(*r) >= 0.5) == y for r, y in zip(rows, labels)]) > 0.95

    def test_held_out_accuracy(self, spark):
        path = "/root/testdata/sf0.01"
        out = quality_model.quality(spark.read.parquet(f"{path}/documents.parquet"), labels := spark.read.parquet(f"{path}/labels.parquet"))
        rows = out.join(labels, "doc_id").where("held_out").collect()
        assert rows and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93

    def test_odd_rows(self, odd_docs, no_labels, no_docs):
        out = quality_model.quality(odd_docs, no_labels).collect()
        assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in out)
        assert quality_model.quality(no_docs, no_labels).count() == 0

    def test_held_out_rows(self, spark):
        import zlib

        df = spark.range(50).select("id", held_out(F.col("id")).alias("h"))
        assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in df.collect())


class TestFingerprints:
    def check(self, docs):
        rows = docs.select("doc_id", "text").collect()
        known = sorted(((r["doc_id"], r["text"] or "") for r in rows if r["doc_id"] is not None), key=lambda r: r[0])
        got = fingerprints.edited_likeness(docs).collect()
        assert len(got) == len(rows)
        by_id = collections.defaultdict(list)
        for r in got:
            by_id[r["doc_id"]].append(r)
        for k, (i, text) in enumerate(known):
            after = known[(k + 1) % len(known)][1]
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            own, made, other = fingerprints.digests(pa.array([text, edited, after]))
            want = (
                len(text), hashlib.sha256(edited.encode()).hexdigest(), own.hex(), made.hex(),
                fingerprints.likeness(own, made), fingerprints.likeness(own, other),
            )
            names = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
            assert want in [tuple(r[c] for c in names) for r in by_id[i]]
        for r in by_id.get(None, []):
            assert r["edited_sha256"] is None and r["fingerprint"]

    def test_whole_table(self, docs):
        self.check(docs)

    def test_many_ranges(self, docs, monkeypatch):
        monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
        self.check(docs)

    def test_ids_beyond_doubles(self, spark, monkeypatch):
        monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
        rows = [((-1) ** k * (2**62 + 12345 * k * k + k), f"text {k} of the ids that are no doubles") for k in range(100)]
        self.check(spark.createDataFrame(rows, "doc_id long, text string"))

    def test_odd_rows(self, odd_docs, no_docs, spark):
        self.check(odd_docs)
        assert fingerprints.edited_likeness(no_docs).count() == 0
        self.check(spark.createDataFrame([(4, "alone here")], "doc_id long, text string"))

    def test_digests_of_a_plain_loop(self):
        def plain(text):
            data, counts = text.encode(), [0] * 1024
            for a, b, c in zip(data, data[1:], data[2:]):
                h = (a | b << 8 | c << 16) * 0x9E3779B1 % 2**32
                h = (h ^ h >> 15) * 0x85EBCA77 % 2**32
                counts[(h ^ h >> 13) % 1024] += 1
            order = sorted(counts)
            codes = [sum(n > order[k] for k in (255, 511, 767)) for n in counts]
            packed = [sum(codes[4 * k + j] << 2 * j for j in range(4)) for k in range(256)]
            return bytes([min(255, round(math.log(len(data) + 1, 1.1))), *packed])

        def score(a, b):
            gaps = [abs((x >> s & 3) - (y >> s & 3)) for x, y in zip(a[1:], b[1:]) for s in (0, 2, 4, 6)]
            return 1 - (sum(6 if g == 3 else g for g in gaps) + 6 * min(abs(a[0] - b[0]), 32)) / (6 * 1024 + 6 * 32)

        r = random.Random(2)
        texts = ["", "a", "ab", "abc", "é", *("".join(r.choice("abc déß☃\n") for _ in range(r.randint(1, 3000))) for _ in range(20))]
        made = fingerprints.digests(pa.array(texts))
        assert made == [plain(t) for t in texts]
        assert all(fingerprints.likeness(a, b) == pytest.approx(score(a, b)) for a in made[::4] for b in made)

    def test_likeness_is_bounded(self):
        a, b, c = fingerprints.digests(pa.array(["", "some text of a kind", "z" * 9999]))
        assert fingerprints.likeness(a, a) == 1.0 and fingerprints.likeness(b, c) == fingerprints.likeness(c, b)
        assert 0 <= fingerprints.likeness(a, c) < 1


PAGE = """<html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body>
<div class="cookie-notice">We use cookies. <button>OK</button></div>
<header class="site-header"><h1>The Site</h1><p>News of the day</p></header>
<nav class="main-menu"><ul><li><a href="/">Home</a><li><a href="/b">About us</a></ul></nav>
<div id="content" class="post"><h1>A fine&nbsp;title</h1>
<p>The first   paragraph, with <b>bold</b> text &amp; signs.
<p>Another one follows, and it is long enough to count as prose in any case.
<div class="ad">Buy this thing now.</div>
<p>The last words of the article are here, to be sure.</div>
<aside class="sidebar"><h3>More</h3><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></aside>
<section class="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>I liked this one, thank you.</p></div></section>
<form class="newsletter"><label>Your mail</label><input type="text"></form>
<footer>&copy; 2024 The Site. All rights.</footer></body></html>"""


class TestHtml:
    def test_blocks(self):
        texts = [b.text for b in html_blocks.blocks(PAGE)]
        assert "The first paragraph, with bold text & signs." in texts and "A fine title" in texts
        assert not any("var x" in t or t == "T" for t in texts)
        assert html_blocks.blocks(None) == html_blocks.blocks("") == html_blocks.blocks("<div> </div>") == []
        assert [b.text for b in html_blocks.blocks("<p>a<br>b<p>c &lt;x&gt; <a hre")] == ["a b", "c <x>"]
        odd = "<p class=it's>one</p><p title=\"a>b\">two</p><a href='x>three <b>four</b> <p>five"
        assert [b.text for b in html_blocks.blocks(odd)] == ["one", "two", "three four", "five"]
        assert html_blocks.blocks('<div id="top"><p class = "ad x">q</div>')[0].near == {"ad", "x"}
        assert html_blocks.blocks("<ul><li>x<li>y</ul>")[1].tags == ("ul", "li")

    def test_elements_left_open_and_long_values(self):
        texts = lambda page: [b.text for b in html_blocks.blocks(page)]
        assert texts("<html><head><title>x</title><meta charset=utf-8><body><article><p>one<p>two</article>") == ["one", "two"]
        assert texts("<head><title>x</title><p>one") == ["one"]
        assert html_blocks.blocks("<head><title>x</title><p>one")[0].tags == ("p",)
        for tag in ("svg", "noscript", "select", "template"):
            assert texts(f"<p>one<{tag}><p>two<p>three") == ["one", "two", "three"]
            assert texts(f"<p>one <{tag}>hidden</{tag}> two") == ["one two"]
        assert texts("<svg><p>one</p><svg>x</svg>") == ["one"]
        assert texts("<p>one<script>var two") == ["one"]
        for n in (3000, 9000, 300_000):
            assert texts(f'<p>one<img src="data:image/png;base64,{"A" * n}=="><p>two<a title="x">three</a>') == ["one", "twothree"]
        assert texts("<p " + "a=b " * 400 + 'title="x>y">one') == ["one"]

    def test_markup_that_looks_like_other_markup(self):
        texts = lambda page: [b.text for b in html_blocks.blocks(page)]
        assert texts("<html><head><meta><body><article><p>one</article>") == ["one"]
        for tag in ("select-box", "title-bar", "head-line", "svg-icon", "template-part"):
            assert texts(f"<{tag}>x</{tag}><p>one<p>two") == ["x", "one", "two"]
        assert texts("<p>one<!--><p>two") == ["one", "two"] and texts("<p>one<!---><p>two") == ["one", "two"]
        assert texts("<p>one<!-- > --><p>two") == ["one", "two"]
        assert texts("<script>a</script foo>one") == ["one"]
        assert texts('<p title="' + "x" * 9000 + '">one') == ["one"]
        assert texts("<p " + " ".join(f'a{k}="<"' for k in range(220)) + ">one") == ["one"]

    def test_articles_without_their_element(self):
        a = "The first sentence is here, and it goes on for a while. Another one follows it."
        b = "Another paragraph with many words, which is no menu and no notice, follows the first one."

        def text(page):
            found = html_blocks.blocks(page)
            return " ".join(x.text for x, main in zip(found, html_extraction.trained().decode(found)) if main)

        assert text(f"<p>{a}</p><p>{b}</p>") == f"{a} {b}"
        nav, foot = '<nav><a href="/">Home</a> <a href="/n">News</a></nav>', "<div class=ad>Buy now.</div><footer>&copy; The Site</footer>"
        assert text(f"<body>{nav}<h1>A title of it</h1><p>{a}</p><p>{b}</p>{foot}") == f"A title of it {a} {b}"
        assert text(f"{nav}<div class=content><h1>A title of it</h1><p>{a}</p><p>{b}</p></div>{foot}") == f"A title of it {a} {b}"
        head = "<article><header><h1>A title</h1><p>The subtitle of it.</p></header>"
        assert text(f"{nav}{head}<p>{a}</p><p>{b}</p></article>{foot}") == f"A title The subtitle of it. {a} {b}"

    def test_time_is_linear(self):
        import time

        begin = time.monotonic()
        for odd in ("<a ", "<a x=", "<a x='", "<svg>", "<!", "<a ='\"", "<select><p>"):
            html_blocks.blocks(odd * 20_000 + "='>'")
        assert time.monotonic() - begin < 20

    def test_decoding_is_the_best_of_all_labellings(self):
        import itertools

        field = html_extraction.Field({"bias": 0.1, "comma": 1.5, "ends": -0.7, "leaf=li": -1.0}, np.random.default_rng(1).normal(0, 1, (2, 2, 2)))
        page = html_blocks.blocks("<ul><li>a, b<li>c.<li>d</ul><p>e, f.<p>g<p>h, i")

        def value(labels):
            total = sum(m for m, y in zip(field.margins(page), labels) if y)
            return total + sum(
                field.pairs[int(page[k].parent == page[k - 1].parent)][int(labels[k - 1])][int(labels[k])] for k in range(1, len(page))
            )

        best = max(itertools.product([False, True], repeat=len(page)), key=value)
        assert tuple(field.decode(page)) == best

    def test_gradient_is_that_of_the_enumerated_likelihood(self):
        import itertools

        page = html_blocks.blocks("<ul><li>a, b<li>c.</ul><p>e, f.<p>g")
        labels = (False, True, True, False)
        pairs = np.random.default_rng(2).normal(0, 1, (2, 2, 2))
        weights = {"bias": 0.3, "comma": 1.5, "ends": -0.7, "leaf=li": -1.0}

        def likelihood(weights, pairs):
            field = html_extraction.Field(weights, pairs)
            margins = field.margins(page)
            same = [int(b.parent == a.parent) for a, b in zip(page, page[1:])]

            def value(ys):
                return sum(m for m, y in zip(margins, ys) if y) + sum(pairs[s][int(a)][int(b)] for s, a, b in zip(same, ys, ys[1:]))

            return value(labels) - np.log(sum(np.exp(value(ys)) for ys in itertools.product([False, True], repeat=len(page))))

        assert len(page) == 4 and {0, 1} == {int(b.parent == a.parent) for a, b in zip(page, page[1:])}
        by_weight, by_pair = html_extraction.gradient(page, labels, html_extraction.Field(weights, pairs))
        step = 1e-5
        for name, got in by_weight.items():
            up, down = ({**weights, name: weights.get(name, 0.0) + d} for d in (step, -step))
            assert got == pytest.approx((likelihood(up, pairs) - likelihood(down, pairs)) / (2 * step), abs=1e-6)
        for place in np.ndindex(2, 2, 2):
            d = np.zeros((2, 2, 2))
            d[place] = step
            assert by_pair[place] == pytest.approx((likelihood(weights, pairs + d) - likelihood(weights, pairs - d)) / (2 * step), abs=1e-6)
        far = html_extraction.marginals([900.0, -900.0, 900.0], [0, 1, 1], pairs)
        assert far[0].tolist() == [1.0, 0.0, 1.0] and np.isfinite(far[1]).all()

    def test_hidden_elements(self):
        texts = lambda page: [b.text for b in html_blocks.blocks(page)]
        for way in ("hidden", 'hidden=""', "HIDDEN class=x", 'class="x"hidden', 'aria-hidden="true"', "aria-hidden=true", "id=a hidden/"):
            assert texts(f"<p>one <span {way}>no</span> two") == ["one two" if not way.endswith("/") else "one no two"], way
            if not way.endswith("/"):
                assert texts(f"<p>one<p {way}>no <b>no</b> no<p>two<div {way}><p>no</p>no</div>three") == ["one", "two", "three"], way
        for way in ('class="hidden"', 'class="a hidden b"', "data-hidden", 'aria-hidden="false"', "hidden=until-found", "title=\"x aria-hidden='true'\"", "hidden-x"):
            assert texts(f"<p>one<p {way}>two") == ["one", "two"], way
        assert texts("<html hidden><body hidden><p>one") == ["one"]

    def test_common_tags_are_read_as_all_others(self, monkeypatch):
        r = random.Random(8)
        parts = ["<p", "<a ", "</p>", " x=", '"', "'", ">", "<", "=", " y", "/", "b", "\n", "<br>", 'class="c d"', "id='e'", "<!--", "-->"]
        odd = ["".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(4000)]
        fast = [html_blocks.blocks(page) for page in odd]
        monkeypatch.setattr(html_blocks, "_COMMON", re.compile("(?!)"))
        assert fast == [html_blocks.blocks(page) for page in odd]

    def test_article_without_the_rest(self):
        page = html_blocks.blocks(PAGE)
        text = " ".join(b.text for b, main in zip(page, html_extraction.trained().decode(page)) if main)
        assert text == (
            "A fine title The first paragraph, with bold text & signs. Another one follows, and it is long enough to count as prose "
            "in any case. The last words of the article are here, to be sure."
        )

    @pytest.mark.parametrize("kind", sorted(set(html_extraction.KINDS)))
    def test_held_out_pages(self, kind):
        wrong = total = 0
        for page, labels in html_extraction.labelled_pages(60, seed=77, kind=kind):
            wrong += sum(a != b for a, b in zip(html_extraction.trained().decode(page), labels))
            total += len(labels)
        assert wrong / total < 0.03

    def test_whole_table(self, spark, sf_dir):
        import html

        pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
        got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extraction.extract(pages).collect()}
        for r in pages.collect():
            article = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
            article = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", article))
            text = " ".join(html.unescape(article).split())
            assert got[r["page_id"]] == (text, len(text))

    def test_odd_rows(self, spark):
        rows = [(1, "u", None), (None, None, ""), (2, "v", "<p"), (3, "w", "plain"), (3, "w", "plain"), (4, "x", "<p>" * 3000 + "deep")]
        df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
        assert html_extraction.extract(df).count() == len(rows)
        assert html_extraction.extract(df.limit(0)).count() == 0
