"""QA pairs from XML documents."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.text import clean_text, padded_id
from tessella.session import settle

#: Top-level folders whose answers were removed.
EXCLUDED = ("10_MPlus_ADAM_QA", "11_MPlusDrugs_QA", "12_MPlusHerbsSupplements_QA")


def list_files(spark: SparkSession, root: str, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(path, parts, content) of the .xml files below the folders of root, but for excluded ones and files beside those folders; parts is the path below root."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").text(root, wholetext=True)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    tail = F.substring_index(path, "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    rows = read.select(path.alias("path"), F.split(tail, "/").alias("parts"), F.col("value").alias("content"))
    return rows.where((F.size("parts") > 1) & ~F.element_at("parts", 1).isin(*excluded))


def _own_text(element: ET.Element | None) -> str | None:
    return None if element is None else element.text or ""


def parse(documents: DataFrame, name_col: str, content_col: str) -> DataFrame:
    """(name, position, doc_id, source, url, focus, semantic_group, qid, qtype, question, answer) of each pair element, raw.

    Elements are found at any depth and give their text up to a first child element; a document that isn't well formed gives no row. doc_id
    defaults to the name's last part without suffix, source to ``unknown``, url to ''. A question or answer element that is missing is null.
    """
    names = ("name", "position", "doc_id", "source", "url", "focus", "semantic_group", "qid", "qtype", "question", "answer")
    schema = pa.schema([(n, pa.int32() if n == "position" else pa.string()) for n in names])

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    root = ET.fromstring(content or "")
                except ET.ParseError:
                    continue
                stem = (name or "").rsplit("/", 1)[-1].rsplit(".", 1)[0]
                group = next(root.iter("SemanticGroup"), None)
                head = (root.get("id", stem), root.get("source", "unknown"), root.get("url", ""), _own_text(root.find("Focus")), _own_text(group))
                for position, pair in enumerate(root.iter("QAPair")):
                    question, answer = pair.find("Question"), pair.find("Answer")
                    get = (lambda key, q=question: None if q is None else q.get(key))
                    rows.append((name, position, *head, get("qid"), get("qtype"), _own_text(question), _own_text(answer)))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema=schema)

    ddl = ", ".join(f"{n} {'int' if n == 'position' else 'string'}" for n in names)
    return documents.select(F.col(name_col).cast("string"), F.col(content_col)).mapInArrow(run, ddl)


def qa_pairs(parsed: DataFrame) -> DataFrame:
    """Cleaned pairs with question and answer; a missing qid is the document's id and how many pairs it had before, a missing qtype ``unknown``."""
    cleaned = parsed.where(F.col("question").isNotNull() & F.col("answer").isNotNull()).withColumns({"question": clean_text(F.col("question")), "answer": clean_text(F.col("answer"))})
    kept = cleaned.where((F.length("question") > 0) & (F.length("answer") > 0))
    before = F.row_number().over(W.partitionBy("name").orderBy("position")) - 1
    filled = kept.withColumn("_before", before)
    return filled.select("name", "position", "doc_id", F.coalesce("qid", F.concat("doc_id", F.lit("-"), F.col("_before").cast("string"))).alias("qid"), clean_text(F.col("focus")).alias("focus"), F.coalesce("qtype", F.lit("unknown")).alias("qtype"), "question", "answer", "source", "url", clean_text(F.col("semantic_group")).alias("semantic_group"))


def with_sequential_ids(df: DataFrame, order: list[str], name: str = "pair_uid", width: int = 7) -> DataFrame:
    """Adds ids 0, 1, 2, … in the total order of ``order``, which must tell rows apart, with leading zeros.

    Ranges of the order's columns are sorted in parallel and offset by the sizes of those before; no task sees all rows, and only the order's columns are written. A row's other columns join by them.
    """
    keys = df.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = settle(keys).withColumns({"_range": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = sizes.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    numbered = placed.join(F.broadcast(offsets), F.col("_range") == F.col("_r")).select(F.struct(*order).alias("_key"), padded_id(F.col("_offset") + F.col("_row"), width).alias("_id"))
    if set(df.columns) == set(order):
        return numbered.select("_key.*", F.col("_id").alias(name))
    return df.withColumn("_key", F.struct(*order)).join(numbered, "_key").drop("_key").withColumnRenamed("_id", name)


def _escaped(col: Column) -> Column:
    plain = F.regexp_replace(col, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffe\\uffff]", "")
    return F.replace(F.replace(F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def _attribute(key: str, col: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f' {key}="'), _escaped(col), F.lit('"')), F.lit(""))


def pair_element() -> Column:
    """The element of a pair from its columns qid, qtype, question and answer; null parts are left out."""
    question = F.coalesce(F.concat(F.lit("<Question"), _attribute("qid", F.col("qid")), _attribute("qtype", F.col("qtype")), F.lit(">"), _escaped(F.col("question")), F.lit("</Question>")), F.lit(""))
    answer = F.coalesce(F.concat(F.lit("<Answer>"), _escaped(F.col("answer")), F.lit("</Answer>")), F.lit(""))
    return F.concat(F.lit("<QAPair>"), question, answer, F.lit("</QAPair>"))


def document(pairs: Column, doc_id: Column, source: Column, url: Column, focus: Column, group: Column) -> Column:
    """A document around pair elements; null attributes and parts are left out."""
    head = F.concat(F.lit("<Document"), _attribute("id", doc_id), _attribute("source", source), _attribute("url", url), F.lit(">"))
    topic = F.coalesce(F.concat(F.lit("<Focus>"), _escaped(focus), F.lit("</Focus>")), F.lit(""))
    kind = F.coalesce(F.concat(F.lit("<FocusAnnotations><SemanticGroup>"), _escaped(group), F.lit("</SemanticGroup></FocusAnnotations>")), F.lit(""))
    return F.concat(head, topic, kind, F.lit("<QAPairs>"), pairs, F.lit("</QAPairs></Document>"))


def to_xml(pairs: DataFrame) -> DataFrame:
    """(pair_uid, content): one XML document for each pair, as ``parse`` reads them."""
    return pairs.select("pair_uid", document(pair_element(), *(F.col(c) for c in ("doc_id", "source", "url", "focus", "semantic_group"))).alias("content"))
