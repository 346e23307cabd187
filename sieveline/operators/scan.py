"""The scan operator: fragments in, findings out. No shuffle; Catalyst prunes columns and pushes filters below it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..config import Config
from ..functions import expressions
from ..schema import FINDING, FRAGMENT
from .kernel import Kernel, Options, as_row, kernel_for


def attribute(key: str):
    """attributes['key'], the empty string if it is missing."""
    return F.coalesce(F.try_element_at("attributes", F.lit(key)), F.lit(""))


def compile_prefilter(source: str):
    """The prefilter as a Column: true for fragments that are skipped; null (an error) keeps them."""
    return F.coalesce(expressions.to_column(expressions.parse(source), {"attributes": attribute}), F.lit(False))


def prefiltered(fragments: DataFrame, config: Config, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Fragments that the prefilter and the list of excluded paths leave, and that hold text or have a path."""
    if config.prefilter.strip():
        fragments = fragments.where(~compile_prefilter(config.prefilter))
    if excluded:
        fragments = fragments.where(~attribute("path").isin(*excluded))
    return fragments.where((F.coalesce(F.length("raw"), F.lit(0)) > 0) | (attribute("path") != ""))


class Scanner:
    """Finds secrets: `Scanner(config, decode_depth=5).scan(fragments)`."""

    def __init__(self, config: Config, **options):
        self.config, self.options = config.check(), Options(**options).check()

    def scan_string(self, raw: str, **attributes: str) -> list[dict]:
        kernel = kernel_for(self.config, self.options)
        return [as_row(f, kernel, attributes) for f in kernel.scan(raw, 1, attributes)]

    def scan(self, fragments: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
        config, options = self.config, self.options
        schema = to_arrow_schema(StructType.fromDDL(FINDING))

        def run(batches):
            kernel = kernel_for(config, options)
            for batch in batches:
                rows = []
                columns = (batch.column(n).to_pylist() for n in ("fragment_id", "raw", "start_line", "attributes"))
                for fragment_id, raw, line, attributes in zip(*columns):
                    attributes = dict(attributes or ())
                    first = attributes.get("fs.first_fragment", "true") != "false"
                    rows += [{"fragment_id": fragment_id} | as_row(f, kernel, attributes) for f in kernel.scan(raw or "", line or 1, attributes, first)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

        chosen = prefiltered(fragments, config, excluded).select("fragment_id", "raw", "start_line", "attributes")
        return chosen.mapInArrow(run, FINDING)


def scan_text_udtf(spark, config: Config, name: str = "scan_text", **options) -> None:
    """Register a table function: SELECT * FROM docs, LATERAL scan_text(text)."""
    from pyspark.sql.functions import udtf

    checked = Options(**options).check()

    class ScanText:
        def eval(self, raw: str):
            for f in kernel_for(config, checked).scan(raw or ""):
                yield f.rule.id, f.value, f.span[0], f.span[2]

    spark.udtf.register(name, udtf(ScanText, returnType="rule_id string, value string, start_line int, start_column int"))


def fragments_of(df: DataFrame, key: str, text: str, table_name: str, **attributes: str) -> DataFrame:
    """Rows of a table as fragments; the path is table/key."""
    path = F.concat(F.lit(f"{table_name}/"), F.col(key).cast("string"))
    extra = [x for k, v in attributes.items() for x in (F.lit(k), F.col(v) if v in df.columns else F.lit(v))]
    return df.select(path.alias("fragment_id"), F.col(text).alias("raw"), F.lit(1).alias("start_line"), F.create_map(F.lit("path"), path, F.lit("resource"), F.lit("table.row"), *extra).alias("attributes"))


__all__ = ["FRAGMENT", "Kernel", "Options", "Scanner", "attribute", "compile_prefilter", "fragments_of", "prefiltered", "scan_text_udtf"]
