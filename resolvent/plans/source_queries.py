"""Queries of sources and sinks: the driver's tables are written in each source's form to the shared folder and read back."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, table
from ..sources import adapters, readers, sinks


def csv_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Columns under odd headings; a tenth of the rows lacks its type."""
    out = scratch(spark, "csv")
    p = table(spark, sf, "part").select(F.when(F.col("p_size") % 10 != 0, F.concat(F.lit("  "), "p_type")).alias("\ufeffTYPE "), F.concat("p_name", F.lit("  ")).alias(" Title"), F.col("p_partkey").cast("string").alias("other"))
    p.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(out)
    return readers.read_catalogue(spark, out, {"type": "type", "title": "title", "part": "other"}).select("type", "title", F.col("part").cast("long").alias("p_partkey"))


def json_document(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON document over several lines, with an array of records."""
    out = scratch(spark, "json")
    rows = table(spark, sf, "nation").agg(F.to_json(F.struct(F.lit("v1").alias("version"), F.collect_list(F.struct("n_nationkey", "n_name")).alias("nations")), {"pretty": "true"}).alias("value"))
    rows.write.text(out)
    return readers.read_json_document(spark, out, "version STRING, nations ARRAY<STRUCT<n_nationkey: INT, n_name: STRING>>", "nations")


def wrapped_literal(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark, "literal")
    body = F.to_json(F.struct(F.collect_list("r_name").alias("names"), F.count("*").alias("n")))
    table(spark, sf, "region").agg(F.concat(F.lit("window.DATA = "), body, F.lit(";\n")).alias("value")).write.text(out)
    got = readers.read_wrapped_literal(spark, out, "names ARRAY<STRING>, n BIGINT")
    return got.select("n", F.explode("names").alias("r_name"))


def mapping_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with arrows among blank ones and notes."""
    out = scratch(spark, "mapping")
    n = table(spark, sf, "nation")
    line = F.when(F.col("n_nationkey") % 5 == 0, "").when(F.col("n_nationkey") % 5 == 1, F.concat(F.lit("# "), "n_name")).when(F.col("n_nationkey") % 5 == 2, F.concat("n_name", F.lit(" -> "))).otherwise(F.concat(F.lit(" "), F.lower("n_name"), F.lit("->"), "n_name", F.lit(" -> x")))
    n.select(line.alias("value")).write.text(out)
    return readers.read_mapping(spark, out)


def glob_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Row files of several folders by one pattern, counted by folder."""
    out = scratch(spark, "rows")
    table(spark, sf, "supplier").select("s_suppkey", F.pmod("s_nationkey", F.lit(4)).alias("part")).write.partitionBy("part").json(out)
    got = readers.read_rows(spark, f"{out}/part=*/*.json", "s_suppkey BIGINT")
    return got.groupBy(F.regexp_extract("source_file", "part=(\\d+)", 1).cast("int").alias("part")).agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("keys"))


def versioned_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of an artifact are written; the manifest names the first."""
    root = scratch(spark, "artifacts")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    sinks.write_artifact(n, root, "nations", "v1", {"built_from": "nation"})
    sinks.write_artifact(n.where("n_nationkey < 5"), root, "nations", "v2")
    spark.createDataFrame([("nations", "v1")], "artifact string, version string").coalesce(1).write.json(f"{root}/manifest.json")
    return readers.read_versioned(spark, root)["nations"]


def artifact_meta(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark, "meta")
    r = table(spark, sf, "region")
    sinks.write_artifact(r, root, "regions", f"v{r.count()}", {"built_from": ",".join(sorted(x["r_name"] for x in r.select("r_name").collect()))})  # five rows
    return spark.read.schema("artifact STRING, version STRING, built_from STRING").json(f"{root}/regions-meta/version=v*")


def authority_table(spark: SparkSession, sf: str) -> DataFrame:
    """Names looked up in a materialised authority: some have two answers, some none."""
    p = table(spark, sf, "part")
    answers = p.where("p_size > 20").select(F.col("p_name").alias("name"), F.col("p_brand").alias("canonical"), F.col("p_partkey").alias("confidence"))
    return readers.authority_lookup(p.select(F.concat("p_name", F.when(F.col("p_size") < 3, "?").otherwise("")).alias("name")), answers)


def digests(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of one file per region."""
    out = scratch(spark, "digest")
    table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("value")).repartition(1).write.partitionBy("r_regionkey").text(out)
    got = readers.file_digests(spark, f"{out}/*/*.txt")
    return got.select(F.regexp_extract("path", "r_regionkey=(\\d+)", 1).cast("int").alias("r_regionkey"), "length", "sha256")


def minimal_payloads(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 25, F.col("p_brand")).alias("brand"), (F.col("p_size") % 2 == 0).alias("flag"), F.when(F.col("p_size") % 3 == 0, F.array("p_type")).otherwise(F.array().cast("array<string>")).alias("types"), F.lit("secret").alias("supplier"))
    kept = sinks.minimal_payload(p, ["p_partkey", "p_name", "brand", "flag", "types"])
    return kept.select(F.get_json_object("payload", "$.p_partkey").cast("long").alias("p_partkey"), "payload")


def markdown_lines(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("n")).orderBy("n_regionkey")
    return spark.createDataFrame([(i, line) for i, line in enumerate(sinks.markdown_report(spark, "Suppliers", m).split("\n"))], "line_no int, line string")


def _sheet(spark: SparkSession, sf: str, cells: list, file: str = "a", key: str = "p_partkey") -> DataFrame:
    return table(spark, sf, "part").select(F.lit(file).alias("file"), F.col(key).alias("row_no"), F.array(*cells).alias("cells"))


def sheet_fixed_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Serial numbers mark rows; headings repeat among them and the first rows are a letterhead."""
    k = F.col("p_partkey")
    s = _sheet(spark, sf, [F.when(k % 11 == 0, "S.No").when(k % 13 == 0, " ").otherwise(k.cast("string")), F.when(k % 17 == 0, "Product").otherwise(F.concat(F.lit(" "), "p_name")), F.col("p_type")])
    return adapters.fixed_offsets(s, 3, {"label": 1, "kind": 2, "none": 9}, serial=0, header_words=("product",)).select(F.col("row_no").alias("p_partkey"), "label", "kind", "none")


def adapter_union(spark: SparkSession, sf: str) -> DataFrame:
    """Two suppliers' adapters over sheets of different shape, as one table."""
    known = readers.Adapters()

    @known.register("one")
    def one(s: SparkSession, path: str) -> DataFrame:
        return adapters.fixed_offsets(_sheet(s, path, [F.col("p_name"), F.col("p_type")]), 0, {"label": 0, "part_text": 1})

    @known.register("two")
    def two(s: SparkSession, path: str) -> DataFrame:
        return adapters.by_pattern(_sheet(s, path, [F.concat("p_name", F.lit(" (x)")), F.lit("seed"), F.concat(F.col("p_size"), F.lit("%"))]))

    rows = known.all(spark, {"one": sf, "two": sf})
    return rows.select("supplier_id", "row_no", "label", "part_text", "assay_raw")


def sheet_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Headings in the middle of a sheet swap two columns for the rows behind them."""
    k, seven = F.col("p_partkey"), F.floor(F.col("p_partkey") / 7)
    head = F.when(seven % 2 == 0, F.array(F.lit("Product Name"), F.lit("Plant part"))).otherwise(F.array(F.lit("Part used"), F.lit("PRODUCT NAME")))
    row = F.when(seven % 2 == 0, F.array("p_name", "p_type")).otherwise(F.array("p_type", "p_name"))
    s = table(spark, sf, "part").select(F.lit("f").alias("file"), k.alias("row_no"), F.when(k % 7 == 0, head).otherwise(row).alias("cells"))
    return adapters.under_headers(s, "product name", {"label": "product name", "part": "part"}).select(F.col("row_no").alias("p_partkey"), "label", "part")


def sheet_side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    s = _sheet(spark, sf, [F.when(k == 150, "END of list").otherwise(F.col("p_name")), F.col("p_type"), F.when(k % 2 == 0, F.col("p_brand")).otherwise(""), F.col("p_size").cast("string")])
    return adapters.side_by_side(s, [{"label": 0, "kind": 1}, {"label": 2, "kind": 3}], "end of list", start=10).select(F.col("row_no").alias("p_partkey"), "block", "label", "kind")


def sheet_by_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that drift from row to row, found by their shape."""
    k = F.pmod("p_partkey", F.lit(3))
    label, assay = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")), F.concat(F.col("p_size"), F.lit(" %"))
    a = F.array(label, F.lit("HPLC"), assay, F.lit("Leaf"), F.lit("Solarin"))
    b = F.array(F.lit("Root"), F.lit("Lunarin B"), label, F.lit("7"), assay)
    s = table(spark, sf, "part").select(F.lit("f").alias("file"), F.col("p_partkey").alias("row_no"), F.when(k == 0, a).when(k == 1, b).otherwise(F.array(F.col("p_name"), assay)).alias("cells"))
    return adapters.by_pattern(s).select(F.col("row_no").alias("p_partkey"), "label", "assay_raw", "marker", "part_text")


def _workbook(rows: list[tuple[str, int]]) -> bytes:
    """A small workbook of names and numbers: shared and inline strings, numbers, booleans and dates; empty cells are left out.  Its
    list of sheets begins with ``sheet10``, and ``sheet2`` is a decoy."""
    escape = lambda x: x.replace("&", "&amp;").replace("<", "&lt;")
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    ns = f'xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    lines = [
        f'<row r="{i}"><c r="A{i}" t="s"><v>{i - 1}</v></c><c r="C{i}"><v>{k}</v></c><c r="D{i}" t="inlineStr"><is><t>a\u00a0&lt;b></t></is></c><c r="E{i}" t="b"><v>{k % 2}</v></c><c r="F{i}" s="1"><v>{45292 + k}</v></c></row>'
        for i, (_, k) in enumerate(rows, 1)
    ]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Data" sheetId="2" r:id="rId7"/><sheet name="Old" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet2.xml"/><Relationship Id="rId7" Target="worksheets/sheet10.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{escape(name)}</t></si>' for name, _ in rows)}</sst>")
        z.writestr("xl/worksheets/sheet10.xml", f"<worksheet {ns}><sheetData>{''.join(lines)}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1"><v>0</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def sheet_workbook(spark: SparkSession, sf: str) -> DataFrame:
    """One workbook per region, with its nations."""
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))

    def books(batches):
        for b in batches:
            made = [_workbook([(r["n_name"], r["n_nationkey"]) for r in rows]) for rows in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f"region {k}" for k in b.column(0).to_pylist()]), pa.array(made, pa.binary())], ["file", "content"])

    got = readers.xlsx_cells(n.mapInArrow(books, "file string, content binary"))
    return got.select("file", "row_no", F.array_join("cells", "|").alias("cells"))


QUERIES = {f.__name__: f for f in (csv_catalogue, json_document, wrapped_literal, mapping_lines, glob_rows, versioned_artifacts, artifact_meta, authority_table, digests, minimal_payloads, markdown_lines, sheet_fixed_offsets, adapter_union, sheet_sections, sheet_side_by_side, sheet_by_pattern, sheet_workbook)}

ORACLE_SQL = {
    "csv_catalogue": "SELECT p_type AS type, p_name AS title, p_partkey FROM part WHERE p_size % 10 <> 0",
    "json_document": "SELECT n_nationkey, n_name FROM nation",
    "wrapped_literal": "SELECT (SELECT count(*) FROM region) AS n, r_name FROM region",
    "mapping_lines": "SELECT lower(n_name) AS common_name, n_name || ' -> x' AS accepted FROM nation WHERE n_nationkey % 5 > 2",
    "glob_rows": "SELECT s_nationkey % 4 AS part, count(*) AS n, sum(s_suppkey)::BIGINT AS keys FROM supplier GROUP BY 1",
    "versioned_artifacts": "SELECT n_nationkey, n_name FROM nation",
    "artifact_meta": "SELECT 'regions' AS artifact, 'v' || count(*) AS version, string_agg(r_name, ',' ORDER BY r_name) AS built_from FROM region",
    "authority_table": "WITH n AS (SELECT DISTINCT p_name || CASE WHEN p_size < 3 THEN '?' ELSE '' END AS name FROM part), a AS (SELECT p_name AS name, max_by(p_brand, p_partkey) AS canonical FROM part WHERE p_size > 20 GROUP BY 1) SELECT name, canonical, canonical IS NOT NULL AS known FROM n LEFT JOIN a USING (name)",
    "digests": "SELECT r_regionkey, (length(r_name) + 1)::BIGINT AS length, sha256(r_name || chr(10)) AS sha256 FROM region",
    "minimal_payloads": """SELECT p_partkey, '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"' || CASE WHEN p_size > 25 THEN ',"brand":"' || p_brand || '"' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN ',"flag":true' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ',"types":["' || p_type || '"]' ELSE '' END || '}' AS payload FROM part""",
    "markdown_lines": """WITH m AS (SELECT n_regionkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1), l AS (SELECT list_concat(['# Suppliers', '', '| n_regionkey | n |', '|---|---|'], list('| ' || n_regionkey || ' | ' || n || ' |' ORDER BY n_regionkey), ['']) AS ls FROM m) SELECT (generate_subscripts(ls, 1) - 1)::INT AS line_no, unnest(ls) AS line FROM l""",
    "sheet_fixed_offsets": "SELECT p_partkey, p_name AS label, p_type AS kind, '' AS none FROM part WHERE p_partkey >= 3 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 0",
    "adapter_union": "SELECT 'one' AS supplier_id, p_partkey AS row_no, p_name AS label, p_type AS part_text, NULL::VARCHAR AS assay_raw FROM part UNION ALL SELECT 'two', p_partkey, p_name || ' (x)', 'seed', p_size || '%' FROM part",
    "sheet_sections": "WITH h AS (SELECT max(p_partkey) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x, p_partkey, p_name, p_type, max(CASE WHEN p_partkey % 7 = 0 THEN p_partkey END) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS hd FROM part) SELECT p_partkey, CASE WHEN (p_partkey // 7) % 2 = (hd // 7) % 2 THEN p_name ELSE p_type END AS label, CASE WHEN (p_partkey // 7) % 2 = (hd // 7) % 2 THEN p_type ELSE p_name END AS part FROM h WHERE p_partkey % 7 <> 0 AND hd IS NOT NULL",
    "sheet_side_by_side": "SELECT p_partkey, 0 AS block, p_name AS label, p_type AS kind FROM part WHERE p_partkey >= 10 AND p_partkey < 150 UNION ALL SELECT p_partkey, 1, p_brand, p_size::VARCHAR FROM part WHERE p_partkey >= 10 AND p_partkey < 150 AND p_partkey % 2 = 0",
    "sheet_by_pattern": "SELECT p_partkey, p_name || ' (' || p_type || ')' AS label, p_size || ' %' AS assay_raw, CASE p_partkey % 3 WHEN 0 THEN 'Solarin' ELSE 'Lunarin B' END AS marker, CASE p_partkey % 3 WHEN 0 THEN 'Leaf' ELSE 'Root' END AS part_text FROM part WHERE p_partkey % 3 < 2",
    "sheet_workbook": "SELECT 'region ' || n_regionkey AS file, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row_no, n_name || '||' || n_nationkey || '|a <b>|' || CASE WHEN n_nationkey % 2 = 1 THEN 'True' ELSE 'False' END || '|' || strftime(DATE '2024-01-01' + n_nationkey::INT, '%Y-%m-%d 00:00:00') AS cells FROM nation",
}
