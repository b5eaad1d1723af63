"""Rendered Java corpus derived from ``supplier`` and ``part``.

The given tables hold no Java, so a Spark expression renders one source file per
supplier and one method per part.  The per-method and per-file templates are SQL
snippets that both Spark and DuckDB evaluate, so an oracle can compute expected
results from the same columns without ever parsing Java.

Columns the snippets expect: ``p`` (part key), ``pname`` (part name), ``s`` (supplier
key), ``nk`` (nation key), ``sname`` (supplier name), ``n_sup`` (supplier rows),
``n_part`` (part rows).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NL = "chr(10)"


def _i(expr: str) -> str:
    return f"cast(cast({expr} as bigint) as string)"


def _div3(expr: str) -> str:
    return f"cast(floor(({expr}) / 3) as bigint)"


# method name: init for p % 11 = 0 (overloads), else op{p div 3}
METHOD_NAME_SQL = f"CASE WHEN p % 11 = 0 THEN 'init' ELSE concat('op', {_i(_div3('p'))}) END"
CALL_A_SQL = f"concat('op', {_i(_div3('(7 * p + 1) % n_part'))})"
CALL_B_SQL = f"concat('op', {_i(_div3('(13 * p + 5) % n_part'))})"
ROUTE_SQL = f"concat('/r', {_i('p % 40')})"

HTTP_METHOD_SQL = """CASE p % 8 WHEN 0 THEN 'GetMapping' WHEN 1 THEN 'PostMapping' WHEN 2 THEN 'PutMapping'
  WHEN 3 THEN 'DeleteMapping' WHEN 4 THEN 'RequestMapping' WHEN 5 THEN 'GetMapping' ELSE NULL END"""
ENDPOINT_SQL = f"CASE WHEN p % 8 IN (0, 1, 2, 4) THEN {ROUTE_SQL} ELSE NULL END"

# the annotation line (with the indentation of the next line), by p % 8
_ANN_SQL = f"""CASE p % 8
  WHEN 0 THEN concat('@GetMapping("', {ROUTE_SQL}, '")', {NL}, '    ')
  WHEN 1 THEN concat('@PostMapping(value = "', {ROUTE_SQL}, '", consumes = "x/y")', {NL}, '    ')
  WHEN 2 THEN concat('@PutMapping(path = "', {ROUTE_SQL}, '")', {NL}, '    ')
  WHEN 3 THEN concat('@DeleteMapping', {NL}, '    ')
  WHEN 4 THEN concat('@RequestMapping(headers = "h", value = "', {ROUTE_SQL}, '")', {NL}, '    ')
  WHEN 5 THEN concat('@GetMapping({{"/a", "/b", "/c"}})', {NL}, '    ')
  WHEN 6 THEN concat('@PatchMapping("/x")', {NL}, '    ')
  ELSE '' END"""

# exact source of one method: from its first annotation / modifier to its closing brace
METHOD_SOURCE_SQL = f"""concat({_ANN_SQL},
  'public String ', {METHOD_NAME_SQL}, '(int x) {{', {NL},
  '        // handles ', CASE WHEN p % 11 = 0 THEN 'setup' ELSE pname END, ' ghost(', {NL},
  '        String s = "fake(";', {NL},
  '        Widget w = new Widget(1);', {NL},
  '        Runnable r = this::hidden;', {NL},
  '        if (x > 0) {{', {NL},
  '            ', {CALL_A_SQL}, '(x);', {NL},
  '        }}', {NL},
  '        return ', {CALL_B_SQL}, '(x) + log(x);', {NL},
  '    }}')"""

# the block written into the file: a doc comment (not part of the source) + source
METHOD_BLOCK_SQL = f"concat('    /** part ', pname, ' */', {NL}, '    ', {METHOD_SOURCE_SQL}, {NL}, {NL})"

PATH_SQL = f"concat('/repo/src/pkg', {_i('nk')}, '/Supplier', {_i('s')}, '.java')"
CLASS_NAME_SQL = f"concat('Supplier', {_i('s')})"
STEREOTYPE_SQL = """CASE s % 6 WHEN 0 THEN 'RestController' WHEN 1 THEN 'Controller' WHEN 2 THEN 'Service'
  WHEN 3 THEN 'Repository' WHEN 4 THEN 'Component' ELSE NULL END"""
DEP1_SQL = f"concat('Supplier', {_i('(3 * s + 1) % n_sup')})"
DEP2_SQL = f"concat('Supplier', {_i('(5 * s + 2) % n_sup')})"
DEP3_SQL = f"CASE WHEN s % 7 = 0 THEN concat('External', {_i('s % 3')}) ELSE NULL END"

FILE_HEADER_SQL = f"""concat('package pkg', {_i('nk')}, ';', {NL}, {NL},
  'import org.springframework.web.bind.annotation.*;', {NL}, {NL},
  '/* ', sname, ' */', {NL},
  CASE WHEN s % 6 = 5 THEN '' ELSE concat('@', {STEREOTYPE_SQL}, {NL}) END,
  CASE WHEN s % 6 IN (0, 1) THEN concat('@RequestMapping("/nation', {_i('nk')}, '")', {NL}) ELSE '' END,
  'public class ', {CLASS_NAME_SQL}, ' {{', {NL}, {NL},
  '    @Autowired', {NL}, '    private ', {DEP1_SQL}, ' peer;', {NL}, {NL},
  '    @Autowired(required = false)', {NL}, '    private ', {DEP2_SQL}, ' backup;', {NL}, {NL},
  CASE WHEN s % 7 = 0 THEN concat('    @Autowired', {NL}, '    private ', {DEP3_SQL}, ' external;', {NL}, {NL}) ELSE '' END,
  '    private int counter = 0;', {NL},
  '    private String marker = "fake(";', {NL}, {NL})"""
FILE_FOOTER_SQL = f"concat('}}', {NL})"


def _row_count(df: DataFrame):
    """Row count as a scalar subquery (evaluated inside the plan, no driver action)."""
    return df.select(F.count(F.lit(1))).scalar()


def corpus_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part: the method block it renders, keyed by supplier ``s`` and ``p``."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    n = _row_count(supplier)
    n_parts = _row_count(part)
    # the texts are rendered behind the shuffle: a small table is read by few tasks
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return part.select(
        F.col("p_partkey").alias("p"),
        F.col("p_name").alias("pname"),
        (F.col("p_partkey") % n).alias("s"),
        n.alias("n_sup"),
        n_parts.alias("n_part"),
    ).repartition(tasks, "s").withColumn("block", F.expr(METHOD_BLOCK_SQL))


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(path, content): one Java file per supplier."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    n = _row_count(supplier)
    methods = corpus_methods(spark, sf_dir)
    body = methods.groupBy("s").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("p", "block"))), lambda x: x["block"]), ""
        ).alias("body")
    )
    heads = supplier.select(
        F.col("s_suppkey").alias("s"),
        F.col("s_nationkey").alias("nk"),
        F.col("s_name").alias("sname"),
        n.alias("n_sup"),
    )
    return heads.join(body, "s", "left").select(
        F.expr(PATH_SQL).alias("path"),
        F.concat(F.expr(FILE_HEADER_SQL), F.coalesce(F.col("body"), F.lit("")), F.expr(FILE_FOOTER_SQL)).alias("content"),
    )
