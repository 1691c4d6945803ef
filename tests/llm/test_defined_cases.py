"""Every registered query on odd tables: clashing extra columns change nothing, long texts are read whole, empty tables give nothing."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vocabulon.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside or return.
CLASH = ("t", "n", "cls", "blob", "row", "size", "key", "score", "spans", "kept", "level", "rank", "block", "part", "copies", "_key", "_place", "host", "x", "query_id", "n_words", "sequence_id", "stratum", "rows")
LONG = " ".join(f"w{i % 5000}" for i in range(420_000))  # over a slice of 2 MiB
ON_DOCUMENTS = [
    "op2_quality_rules", "op4_substring_dedup", "op5_minhash_near_duplicates", "op7_secret_scan", "op8_source_mixing", "op9_best_fit_packing", "op10_personal_data", "op12_toxic_spans",
]
OTHERS = ["op1_html_extraction", "op3_url_filter", "op6_nearest_vectors", "op11_embedding_whitening", "op13_peak_concurrency"]


def texts():
    body = " ".join(f"v{i}" for i in range(80))
    rows = [(i, f"text {i} has few words, mail a{i}@example.org and token = abcdef{i}", f"s{i % 2}") for i in range(12)]
    return [*rows, (20, body, "s0"), (21, body, "s1"), (22, f"{body} more", None), (30, None, "s0"), (31, "", "s1"), (32, " \t\n", None), (None, "no id", "s0"), (40, LONG, "s1"), rows[3], rows[3]]


def write(spark, at, clash, empty):
    def save(rows, kind, name):
        df = spark.createDataFrame(rows, kind)
        have = {c.lower() for c in df.columns}
        df = df.where("false") if empty else df
        for c in CLASH if clash else ():
            if c not in have:
                df = df.withColumn(c, F.lit("clash"))
        df.coalesce(2).write.parquet(f"{at}/{name}.parquet")

    save([(i, t, "en", s, len(t or "")) for i, t, s in texts()], "doc_id long, text string, lang string, source string, n_chars int", "documents")
    save([(i, i % 2, (i + 1) % 2) for i in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int", "labels")
    page = "<html><body><nav><a href=/>Home</a><a href=/b>More</a></nav><article><h1>Title</h1><p>" + "Many words make a paragraph of some length. " * 6 + "</p></article></body></html>"
    save([(1, "http://a.net/x", page), (2, None, None), (3, "no scheme", ""), (4, "https://b.org/fr/" + "p" * 100_000, page), (1, "http://a.net/x", page)], "page_id long, url string, html string", "pages")
    vectors = [(i, [float((i * k) % 7) / 8 + 0.01 for k in range(1, 5)], i) for i in range(60)]
    save([*vectors, (60, None, 0), (61, [float("nan")] * 4, 0), (20, vectors[20][1], 1), (None, [0.5] * 4, 1)], "vec_id long, embedding array<float>, label int", "embeddings")
    day = lambda d: datetime(2024, 1, d)
    save([(1, 1, "ok", 2.5, day(1), day(1), "p"), (2, 9, None, None, day(2), None, None), (3, 1, "ok", 1.0, None, None, None), (1, 1, "ok", 2.5, day(1), day(1), "p")], "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority string", "sales")
    save([(1, 1, day(3)), (1, 2, None), (None, 1, day(1))], "sale_id long, line_no int, shipped_at timestamp_ntz", "sale_lines")
    save([(1, 5), (2, None)], "client_id long, nation_id int", "clients")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    for name, clash, empty in (("plain", False, False), ("clash", True, False), ("empty", False, True)):
        write(spark, f"{at}/{name}", clash, empty)
    return at


def rows(spark, name, folder, without=()):
    df = queries.queries()[name](spark, str(folder))
    return sorted((tuple(r) for r in df.select([c for c in df.columns if c not in without]).collect()), key=repr)


@pytest.mark.parametrize("name", [*ON_DOCUMENTS, *OTHERS])
def test_clashing_columns_change_nothing(spark, tables, name):
    packed = ("sequence_id", "offset") if name.startswith("op9") else ()  # bins follow the partitions
    plain = rows(spark, name, tables / "plain", packed)
    assert plain and plain == rows(spark, name, tables / "clash", packed)
    if name in ON_DOCUMENTS and name != "op9_best_fit_packing":
        assert sorted(repr(r[0]) for r in plain) == sorted(repr(i) for i, *_ in texts())  # a row a row, null ids and repeated rows too


@pytest.mark.parametrize("name", [*ON_DOCUMENTS, *OTHERS])
def test_empty_tables_give_nothing(spark, tables, name):
    assert rows(spark, name, tables / "empty") == []


def test_a_text_longer_than_a_slice_is_read_whole(spark, tables):
    n = 420_000
    of = {q: {r["doc_id"]: r for r in queries.queries()[q](spark, str(tables / "plain")).where("doc_id = 40").collect()}[40] for q in ("op2_quality_rules", "op4_substring_dedup", "op5_minhash_near_duplicates", "op8_source_mixing")}
    assert (of["op2_quality_rules"]["n_words"], of["op2_quality_rules"]["n_repeat_words"], of["op2_quality_rules"]["word_chars"]) == (n, n, sum(map(len, WORD.findall(LONG))))
    assert (of["op4_substring_dedup"]["n_words"], of["op4_substring_dedup"]["n_removed"]) == (n, 0)  # it repeats itself only
    assert of["op5_minhash_near_duplicates"]["n_shingles"] == 5000 and of["op8_source_mixing"]["size"] == n
    pieces = queries.op9_best_fit_packing(spark, str(tables / "plain")).where("doc_id = 40").orderBy("piece").collect()
    assert [p["start"] for p in pieces] == [4096 * i for i in range(len(pieces))] and all(p["length"] == 4096 for p in pieces[:-1]) and sum(p["length"] for p in pieces) > n
