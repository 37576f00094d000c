import collections
import hashlib
import math
import struct
import zlib

import duckdb
import pytest
import test_corpus_operators as brute_force
from tokenizers import Tokenizer

import corpus_pipeline
from tidewater.llm import line_dedup, queries, toxicity
from tidewater.plans.storage import materialize

CONTRACTS = {
    "op1_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op2_line_dedup": {"doc_id", "n_lines", "n_dropped"},
    "op3_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op4_near_duplicates": {"doc_id", "n_shingles", "component_id", "kept"},
    "op5_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op6_html_extraction": {"page_id", "url", "text", "n_chars"},
    "op7_quality_model": {"doc_id", "held_out", "score", "predicted"},
    "op8_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op9_kd_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op10_source_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op11_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op12_merkle_manifest": {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"},
    "op13_periodic_runs": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
}


def test_every_operator_has_a_query():
    assert set(queries.queries()) == set(CONTRACTS)


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_query_covers_its_table(spark, sf_dir, name):
    out = queries.queries()[name](spark, sf_dir)
    assert CONTRACTS[name] <= set(out.columns)
    key = "page_id" if "page_id" in out.columns else "doc_id"
    table = spark.read.parquet(f"{sf_dir}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    got = out.select(key).collect()
    assert {r[0] for r in got} == {r[0] for r in table.select(key).collect()}
    assert name.startswith("op3") or len(got) == table.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_says_what_its_sql_says(spark, sf_dir, tmp_path, name):
    # The table, and rows on which rules tell scripts, capitals and figures apart.
    latin, cyrillic = "Zorp blit quam frex ".split(" "), "погода сегодня была хорошая ".split(" ")
    more = [" ".join(f"{w[k % 4]}{chr(97 + k % 26)}" for k in range(70)) for w in (latin, cyrillic)]
    more += [more[0] + " THE AND", "。 ".join("今天天气很好孩子们在公园里玩" + chr(0x4E00 + 7 * k) for k in range(60)), "", None, " \n\t", "1 2\n" * 30]
    more += [f"A\t shared  line of 2{k} figures and words\nown {chr(97 + k)}" for k in range(9)]
    extra = spark.createDataFrame([(10**6 + k, t, None, "src") for k, t in enumerate(more)], "doc_id long, text string, lang string, source string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(extra, allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    more = spark.createDataFrame([(10**6 + k, "u", h) for k, h in enumerate(["a", None, "", "a", "WARC/1.0\r\n"])], "page_id long, url string, html string")
    pages.unionByName(more).write.parquet(f"{tmp_path}/pages.parquet")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    out = queries.queries()[name](spark, str(tmp_path))
    columns = sorted(out.columns)
    rows = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(rows, key=repr) == sorted((tuple(r) for r in out.select(*columns).collect()), key=repr)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def by_toxicity(given, docs, labels):
    match = toxicity.Matcher(toxicity.learn(docs, labels))
    return [(i, t) for i, t in given if match.score(t or "") < 0.5]


def by_lines(given, docs, labels):
    text = brute_force.TestLineDedup.brute(given, line_dedup.MIN_DOCS, line_dedup.SIMILARITY, passages=True, near=70)
    return [(i, t if t is None else text[t]) for i, t in given]


def by_likeness(given, docs, labels):
    _, root = brute_force.TestNearDedup.roots(given, 80)
    return [(i, t) for i, t in given if root[i] == i]


def by_mix(given, docs, labels):
    words = lambda t: len((t or "").encode().split())
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    sizes = collections.Counter({s: 0 for s in source.values()})
    for i, t in given:
        sizes[source[i]] += words(t)
    sizes = {s: n for s, n in sizes.items() if any(source[i] == s for i, _ in given)}
    out = []
    for s, target in brute_force.TestMixing.targets(sizes, 1.5, 2.0).items():
        whole = int(target // max(1, sizes[s]))
        left = math.floor(target - whole * sizes[s] + 0.5)
        own = [(i, t) for i, t in given if source[i] == s]
        for i, t in sorted(own, key=lambda r: hashlib.md5(f"17:{r[0]}:{r[1] or ''}".encode()).hexdigest()[:15]):
            times = whole + (left > 0) if words(t) else max(whole, 1)
            out += [(i, t)] * times
            left -= words(t)
    return out


def by_pieces(given):
    tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    for i, t in given:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            piece = ids[k : k + 4096]
            yield i, k // 4096, k, len(piece), zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))


def test_run_is_what_brute_force_makes_of_each_stage(spark, sf_dir, docs, labels):
    given = docs
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (by_toxicity, by_lines, by_likeness, by_mix)):
        out = materialize(stage(spark, given, sf_dir), f"test-{name}")
        assert out.columns == docs.columns, name
        want = plain(rows_of(given), given, labels)
        assert sorted(rows_of(out), key=repr) == sorted(want, key=repr), name
        given = out
    run = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(tuple(r)[:5] for r in run) == sorted(by_pieces(rows_of(given)))
    places = collections.defaultdict(list)
    for r in run:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in places.values():
        ends = [0, *(place + size for place, size in sorted(items))]
        assert [place for place, _ in sorted(items)] == ends[:-1] and ends[-1] <= 4096
    assert len(places) <= 1.02 * -(-sum(r["length"] for r in run) // 4096) + 1


def test_each_stage_takes_odd_and_empty_tables(spark, sf_dir, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, sf_dir)
        assert out.count() > 0
        assert name == "packing" or out.columns == odd_docs.columns
        assert stage(spark, no_docs, sf_dir).count() == 0
