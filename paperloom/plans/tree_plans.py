"""Extractor trees made from the driver's conversations, a block a turn, and what is mapped from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import merging
from paperloom.plans.registry import query
from paperloom.sources import trees
from paperloom.sources.tables import table


def _object(**fields: Column) -> Column:
    """A JSON object of columns that are JSON already; names are given with _ for a blank."""
    parts = [F.concat(F.lit(f'"{n.replace("_", " ")}":'), c) for n, c in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _text(c: Column | str) -> Column:
    """A JSON string of a column or a value."""
    inner = F.to_json(F.struct((c if isinstance(c, Column) else F.lit(c)).alias("x")))
    return F.substring(inner, F.lit(6), F.length(inner) - 6)


def _list(*items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, t, c = table(spark, sf_dir, "conversations"), F.col("turn"), F.col("conv_id")
    role, text = _text(F.col("role")), _text(F.col("text"))
    inner = _object(type=_text("List"), numbering_style=_text("roman numbers"), list_items=_list(_object(content=_text("x")), _object(text=_text("y"))))
    item = _object(content=role, kids=_list(_object(type=_text("paragraph"), content=role), inner))
    cell = lambda r, k, what, **more: _object(row_number=F.lit(str(r)), Column_Number=_text(str(k)), content=what, **more)
    low = F.when(c % 3 == 0, _list(cell(2, 1, text))).otherwise(_list(cell(2, 1, text), cell(2, 2, _text("z"))))
    rows = _list(_object(cells=_list(cell(1, 1, role, column_span=F.lit("2")))), _object(cells=low))
    said = {
        0: {"type": _text("Heading"), "heading-level": F.when(t == 0, _text("Doctitle")).otherwise(F.lit("1")), "content": _text(F.concat("role", F.lit(" "), t))},
        1: {"TYPE": _text("paragraph"), "kids": _list(_object(type=_text("text block"), content=text))},
        2: {"type": _text("list"), "numbering style": _text("English letters upper case"), "list items": _list(item, _object(text=text))},
        3: {"type": _text("table"), "number of rows": F.lit("2"), "number_of_columns": F.lit("2.0"), "rows": rows},
        4: {"type": _text("image"), "source": _text(F.concat(F.lit("img/"), t, F.lit(".png")))},
        5: {"type": _text("caption"), "content": F.when(c % 5 == 0, _text(" ")).otherwise(text)},
    }
    page = (F.floor(t / 4) + 1).cast("string")
    shared = {"page number": F.when(t % 2 == 1, _text(page)).otherwise(page)}
    corners = F.when(t % 7 == 3, F.array(*map(F.lit, (5, 5, 1, 9)))).otherwise(F.array(F.lit(0), t.cast("int"), F.lit(10), (t + 1).cast("int")))
    boxed = F.when(t % 7 == 4, F.lit("")).otherwise(F.concat(F.lit(',"Bounding Box":'), F.to_json(corners)))
    kinds = [F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), v) for n, v in (said[k] | shared).items()]), boxed, F.lit("}")) for k in range(6)]
    block = F.element_at(F.array(*kinds), (t % 6 + 1).cast("int"))
    per = own.groupBy(c.alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("all"))
    tree = F.concat(F.lit('{"kids":['), F.array_join(F.transform("all", lambda x: x["b"]), ","), F.lit("]}"))
    return per.select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("source_sha256"), tree.alias("tree"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image file a turn, of two contents; some documents have none."""
    own = table(spark, sf_dir, "conversations").where("conv_id % 4 <> 1")
    return own.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("out/"), F.col("turn"), F.lit(".PNG")).alias("path"), F.md5((F.col("turn") % 3).cast("string")).alias("sha256"))


_SAID = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_CELL = f"replace({_SAID}, '|', '\\|')"
_BLOCKS = f"""b AS (SELECT conv_id AS doc_id, turn, role, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pos, turn // 4 + 1 AS page, ['heading', 'paragraph', 'list', 'table', 'image', 'caption'][turn % 6 + 1] AS kind,
  CASE turn % 6 WHEN 0 THEN role || ' ' || turn::VARCHAR WHEN 1 THEN {_SAID} WHEN 2 THEN 'A. ' || role || chr(10) || '  i. x' || chr(10) || '  ii. y' || chr(10) || trim('B. ' || {_SAID}) WHEN 3 THEN '| ' || role || ' |  |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || {_CELL} || ' | ' || CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'z' END || ' |' WHEN 4 THEN '' ELSE CASE WHEN conv_id % 5 = 0 THEN '' ELSE {_SAID} END END AS content,
  CASE WHEN turn % 7 NOT IN (3, 4) THEN '0,' || turn::VARCHAR || ',10,' || (turn + 1)::VARCHAR END AS bbox FROM conversations),
files AS (SELECT conv_id AS doc_id, turn, 'out/' || turn::VARCHAR || '.PNG' AS path, md5((turn % 3)::VARCHAR) AS sha FROM conversations WHERE conv_id % 4 <> 1),
typed AS (SELECT *, CASE WHEN kind = 'heading' AND turn = 0 THEN 'TITLE' ELSE upper(kind) END AS type FROM b), kept AS (SELECT * FROM typed WHERE content <> '' OR kind = 'image'),
pathed AS (SELECT *, coalesce(last_value(CASE WHEN type = 'TITLE' THEN (pos, content) END IGNORE NULLS) OVER w, first_value(CASE WHEN type = 'HEADING' THEN (pos, content) END IGNORE NULLS) OVER w) AS root, last_value(CASE WHEN type = 'HEADING' THEN (pos, content) END IGNORE NULLS) OVER w AS second FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
elements AS (SELECT *, 'element-' || substr(sha256(md5(doc_id::VARCHAR) || '|' || pos::VARCHAR || '|' || page::VARCHAR || '|' || kind), 1, 24) AS element_id FROM pathed)"""


@query(
    f"""WITH {_BLOCKS} SELECT element_id, 'anchor' || substr(element_id, 8) AS anchor_id, doc_id, pos, page::INT AS page, type, md5(content) AS content, array_to_string(list_filter([root[2], CASE WHEN second[1] > root[1] THEN second[2] END], lambda x: x IS NOT NULL), ' > ') AS path, coalesce(bbox, '') AS bbox,
    CASE kind WHEN 'table' THEN 2 END::INT AS rows, CASE kind WHEN 'table' THEN 1 END::INT AS merged, CASE kind WHEN 'table' THEN (doc_id % 3 = 0)::INT END AS flaws FROM elements"""
)
def tree_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trees.tree_elements(_documents(spark, sf_dir))
    corners = F.coalesce(F.array_join(F.transform("bbox", lambda x: x.cast("int").cast("string")), ","), F.lit(""))
    return found.select("element_id", "anchor_id", "doc_id", "pos", "page", "type", F.md5("content").alias("content"), F.array_join("path", " > ").alias("path"), corners.alias("bbox"), "rows", "merged", "flaws")


@query(
    f"""WITH {_BLOCKS} SELECT doc_id, pos, page::INT AS page, 'invalid_source_bbox' AS code FROM b WHERE turn % 7 = 3 UNION ALL SELECT doc_id, pos, page::INT, 'table_grid_mapping_failed' FROM b WHERE kind = 'table' AND doc_id % 3 = 0
    UNION ALL SELECT doc_id, pos, page::INT, 'empty_mapped_source_block' FROM b WHERE kind <> 'image' AND content = '' UNION ALL SELECT doc_id, pos, page::INT, 'unresolved_image_reference' FROM b WHERE kind = 'image' AND doc_id % 4 = 1"""
)
def tree_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.tree_issues(_documents(spark, sf_dir), _images(spark, sf_dir))


@query(
    f"""WITH {_BLOCKS}, g AS (SELECT doc_id, sha, array_to_string(list_sort(list(DISTINCT path)), ',') AS paths FROM files GROUP BY ALL), r AS (SELECT e.doc_id, sha, count(*) AS n FROM elements e JOIN files f ON f.doc_id = e.doc_id AND f.turn = e.turn WHERE kind = 'image' GROUP BY ALL)
    SELECT 'asset-' || substr(sha256(doc_id::VARCHAR || '|' || sha), 1, 24) AS asset_id, doc_id, sha AS content_sha256, paths, coalesce(n, 0)::INT AS elements, CASE sha WHEN md5('0') THEN 'DECORATIVE' WHEN md5('1') THEN 'INFORMATIVE' ELSE 'UNKNOWN' END AS classification, CASE sha WHEN md5('0') THEN 'BRAND_LOGO' WHEN md5('1') THEN 'FIGURE' ELSE 'UNKNOWN' END AS role, sha = md5('1') AS indexable FROM g LEFT JOIN r USING (doc_id, sha)"""
)
def tree_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = spark.range(2).select(F.md5(F.col("id").cast("string")).alias("content_sha256"), F.when(F.col("id") == 0, "DECORATIVE").otherwise("INFORMATIVE").alias("classification"), F.when(F.col("id") == 0, "BRAND_LOGO").otherwise("FIGURE").alias("role"), (F.col("id") == 1).alias("indexable"))
    found = trees.tree_assets(_images(spark, sf_dir), trees.tree_elements(_documents(spark, sf_dir)), policies)
    return found.withColumns({"paths": F.array_join("paths", ","), "elements": F.size("elements")})


@query(
    """WITH f AS (SELECT conv_id AS doc_id, turn, 'out/' || turn::VARCHAR || '.PNG' AS path FROM conversations WHERE conv_id % 4 <> 1) SELECT doc_id, path FROM f WHERE turn % 3 <> 1 AND turn % 6 <> 4"""
)
def markdown_only_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three files are named in Markdown, image blocks refer to some."""
    own, t = table(spark, sf_dir, "conversations"), F.col("turn")
    said = F.concat(F.lit("text ![a b]("), F.when(t % 2 == 0, "x/y/").otherwise(""), t, F.lit(".PNG) and [no]("), t + 100, F.lit(".PNG)"))
    markdown = own.where(t % 3 != 1).groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.collect_list(said), "\n").alias("markdown"))
    images = _images(spark, sf_dir).select("doc_id", "path")
    return merging.markdown_only_images(markdown, images, images.where(F.regexp_extract("path", r"(\d+)", 1).cast("int") % 6 == 4))
