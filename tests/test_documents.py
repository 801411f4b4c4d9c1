"""Document, harvest and stream queries against a second engine; fixtures where SQL doesn't reach."""

import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F
from test_catalog import SF, TABLES, rows

from brambling.functions import text as tx
from brambling.operators import documents as docs_ops
from brambling.plans import catalog, documents
from brambling.sources import harvest

NEW = [n for n, q in catalog.QUERIES.items() if n in catalog.ORACLE_SQL and (q.__module__ == documents.__name__ or n == "job_reschedule")]


@pytest.mark.parametrize("name", NEW)
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(catalog.ORACLE_SQL[name]).df())


def test_versions_sort(spark):
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.2", "1.0.0-alpha.10", "1.0.0-alpha.x", "1.0.0-beta", "1.0.0", "1.0.1", "1.10.0", "2.0.0"]
    df = spark.createDataFrame([(v,) for v in reversed(order + ["no", None])], "v string").select("v", tx.semver_key(F.col("v")).alias("k"))
    assert [r.v for r in df.filter("k is not null").orderBy("k").collect()] == order and df.filter("k is null").count() == 2


def test_text_expressions(spark):
    t = F.col("t")
    df = spark.createDataFrame([("写一个智能体叫「小明」，负责代码和测试",), ("hi",), ("plan it, please: one word",), (None,)], "t string")
    got = df.select(tx.first_match(t), tx.excerpt(t, ["负责", "please"], 4), tx.capabilities(t), tx.intent(t), tx.mention(t)).collect()
    assert tuple(got[0])[:2] == ("小明", "负责代码") and got[0][2] == ["代码生成", "代码审查", "重构建议", "测试用例生成", "自动化测试", "测试报告"] and got[0][3] == "agent_producer"
    assert tuple(got[1]) == (None, None, tx.CAPABILITIES_DEFAULT, None, None) and got[2][3] == "pwa" and got[2][1] == "plea" and got[3][3] is None


def test_markdown_blocks(spark):
    md = "# A\n\n| h | k |\n|---|---|\n| 1 | 2 |\n```\n| code |\n# no\n```\n> q\n- i\n2. j\n***\n| not a table |\ntext"
    got = docs_ops.blocks(spark.createDataFrame([(1, md), (2, None), (3, "")], "doc_id int, text string")).orderBy("line_no").collect()
    assert [(r.kind, r.cells) for r in got] == [
        ("heading", ["A"]), ("table_header", ["h", "k"]), ("table_row", ["1", "2"]), ("code", ["| code |"]), ("code", ["# no"]), ("quote", ["q"]),
        ("ul", ["i"]), ("ol", ["j"]), ("rule", ["***"]), ("text", ["| not a table |"]), ("text", ["text"]),
    ]
    assert docs_ops.headings(spark.createDataFrame([(1, md)], "doc_id int, text string")).collect()[0].title == "A"


def test_sources(spark, tmp_path):
    read = lambda js: spark.read.json(spark.sparkContext.parallelize([js]))
    s2 = harvest.normalise_semantic_scholar(read('{"paperId":"p","externalIds":{"DOI":"10.1/X","ArXiv":null},"title":"T","abstract":null,"authors":[{"name":"A"},{"name":""}],"publicationDate":"2024-01-01","url":"u","openAccessPdf":{"url":"f"},"publicationTypes":["a","b"],"citationCount":3}'))
    core = harvest.normalise_core(read('{"id":7,"doi":"doi:10.2/y","arxivId":null,"title":"T","abstract":"","authors":["A"],"publishedDate":"","sourceFulltextUrls":["s"],"downloadUrl":null,"type":"x","updatedDate":null}'))
    pmc = harvest.normalise_europe_pmc(read('{"id":"9","source":"MED","doi":null,"pmcid":"PMC1","title":"T","abstractText":"","authorString":"A, B","firstPublicationDate":null,"pubYear":"2020","isOpenAccess":"Y","pubType":"j","lastUpdateDate":"","citedByCount":1}'))
    (tmp_path / "a.xml").write_text("<feed><entry><id>http://arxiv.org/abs/1.2v3</id><title> A\n b</title><summary>s</summary><author><name>N</name></author><author><name>M</name></author><published>p</published><updated>u</updated></entry></feed>")
    arxiv = harvest.normalise_arxiv(harvest.read_atom(spark, str(tmp_path / "a.xml")))

    def broken():
        raise OSError("no answer")

    found, report = harvest.harvest({"s2": lambda: s2, "bad": broken, "core": lambda: core, "pmc": lambda: pmc, "arxiv": lambda: arxiv}, str(tmp_path / "staging"))
    by = {r.source: r for r in found.collect()}
    assert [(r["source"], r["status"], r["received"]) for r in report] == [("s2", "ok", 1), ("bad", "failed", 0), ("core", "ok", 1), ("pmc", "ok", 1), ("arxiv", "ok", 1)]
    assert (by["s2"].doi, by["s2"].authors, by["s2"].oa_status, by["s2"].work_type) == ("10.1/x", ["A", ""], "open", "a,b")
    assert (by["core"].source_id, by["core"].doi, by["core"].landing_url, by["core"].oa_status) == ("7", "10.2/y", "s", "open")
    assert (by["pmc"].published, by["pmc"].authors, by["pmc"].oa_url) == ("2020", ["A", "B"], "https://europepmc.org/articles/PMC1")
    assert (by["arxiv"].arxiv_id, by["arxiv"].title, by["arxiv"].authors) == ("1.2v3", "A b", ["N", "M"])


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>one</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>")
    (tmp_path / "good.docx").write_bytes(out.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    assert [r.content for r in harvest.docx_files(spark, str(tmp_path)).collect()] == ["one two\nthree"]


def test_diff_and_contract(spark):
    r = spark.createDataFrame([("a\nb\n", "a\nc\n")], "o string, n string").select(docs_ops.unified_diff("o", "n")).first()[0]
    assert "-b" in r and "+c" in r
    got = spark.createDataFrame([("1",), ("[1]",), ("{",), (None,)], "t string").select(tx.output_contract(F.col("t"), "boolean")).collect()
    assert [x[0] for x in got] == [None, "expected boolean, got list", "expected boolean, got non-JSON", "expected boolean, got non-JSON"]
