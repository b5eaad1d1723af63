"""B2-B11: structure extraction as relational rules over the token table.

Pipeline (the text is shuffled once, on the file key; after it only what members and files come to):

    files --key/repartition--> token_table (Arrow running sums) --groupBy(file, region, seg)-->
    segments --groupBy(file)--> per-file record --join(file key)--> parsed

``parsed`` has one row per input file:
    path, class_name, stereotype, autowired_deps ARRAY<STRING>,
    methods ARRAY<STRUCT<pos, name, http_method, endpoint, source_code, calls>>, error
and ``flat_methods`` explodes it to one row per declared method.

Rules (reproducing a syntax-tree extraction of Java without building a tree):
* class name: name after the first top-level ``class``; else the file stem.
* stereotype: first simple-name annotation in a top-level class header that is one
  of the stereotype names, over all top-level classes in order.
* deps: the type text of every ``@Autowired`` field of any top-level class.
* methods: direct method declarations of every top-level class body (constructors
  and nested types excluded), all owned by the file's class name.
* http mapping / endpoint: first mapping annotation among the method's modifiers;
  endpoint from a bare string argument or a ``value=`` / ``path=`` string.
* calls: every invocation name inside the method, in source order.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import lexicon as L
from graphloom.functions import text as T
from graphloom.operators.tokens import FILE_KEY, key_files, token_table

METHOD_STRUCT = (
    "struct<pos:bigint,name:string,http_method:string,endpoint:string,source_code:string,calls:array<string>>"
)


def _ident(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"^[\p{L}_$]")


def _nz(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def segments(tokens: DataFrame) -> DataFrame:
    """One row per (file, region, member segment) with the facts the rules need.

    Inside a member's own braces only an opening paren can be a fact (a call); of the other tokens there its edges count.
    """
    tokens = tokens.where((F.col("bd") <= 1) | (F.col("tok") == "(") | F.col("edge"))
    tok, bd, pd = F.col("tok"), F.col("bd"), F.col("pd")
    p1, p2, p3, n1, n2 = (F.col(c) for c in ("p1", "p2", "p3", "n1", "n2"))
    ident = _ident(tok)
    body = (F.col("rkw") == "class") & (bd >= 1) & ~((tok == "}") & (bd == 1))
    hdr = body & (bd == 1) & (pd == 0)
    simple_ann = (tok == "@") & _ident(n1) & (_nz(n2) != ".")
    p1_type_end = _nz(p1).isin(">", "]") | (
        _ident(p1) & ~_nz(p1).isin(L.NON_TYPE_KEYWORDS) & ~F.coalesce(F.col("p1_ann"), F.lit(False))
    )
    name_cand = hdr & ident & (_nz(n1) == "(") & ~tok.isin(L.NON_TYPE_KEYWORDS) & ~F.col("ann") & p1_type_end
    nested_kw = hdr & (_nz(p1) != ".") & (
        tok.isin("class", "interface", "enum") | ((tok == "record") & _ident(n1))
    )
    # a declaration without a body (of a local interface): a type stands before the name and ")" ";" follows
    typed = (_nz(p2) == "]") | ((_nz(p2) == ">") & (_nz(F.col("p4")) == "<") & _ident(F.col("p5"))) | (_ident(p2) & ~_nz(p2).isin(L.NON_TYPE_KEYWORDS))
    bodiless = (_nz(F.col("close_next")) == ";") & typed
    # new A<B>.C(...): the chain after "new" goes through type arguments
    generic_new = (_nz(p2) == ".") & (_nz(p3) == ">")
    # a call is decided on its "(" row: the identifier before it, not a keyword,
    # not an annotation name, not after new, and not a declaration ") {" / ") throws"
    call_row = (
        body
        & (tok == "(")
        & ~((bd == 1) & (pd == 0))
        & _ident(p1)
        & ~_nz(p1).isin(L.CALL_KEYWORDS)
        & ~(_nz(p1).isin(L.CONTEXT_KEYWORDS) & (_nz(p2) != "."))
        & ~F.coalesce(F.col("p1_ann"), F.lit(False))
        & ~F.coalesce(F.col("p1_new"), F.lit(False))
        & ~_nz(F.col("close_next")).isin("{", "throws")
        & ~bodiless
        & ~generic_new
    )
    is_str = tok.startswith('"')
    arg_level = body & (bd == 1) & (pd == 1) & is_str & _nz(n1).isin(",", ")")
    bare = _nz(p1).isin("(", ",")
    pair = (_nz(p1) == "=") & _nz(p2).isin("value", "path") & _nz(p3).isin("(", ",")
    lit_cand = arg_level & (bare | pair)
    modlike = (
        (tok == "@") | F.col("ann") | F.col("ann_dot")
        | ((tok == "(") & F.coalesce(F.col("p1_ann"), F.lit(False)))
        | tok.isin(L.MODIFIERS)
    )
    decl_cand = hdr & ident & p1_type_end & ~tok.isin(L.NON_TYPE_KEYWORDS) & _nz(n1).isin("=", ";", ",", "[")
    top_ann = (bd == 0) & (pd == 0) & simple_ann & n1.isin(L.STEREOTYPES)
    end = F.col("off") + F.length(tok)

    def when_body(cond: Column, value: Column) -> Column:
        return F.when(body & cond, value)

    return tokens.groupBy(*FILE_KEY, "region", "seg").agg(
        # region-level facts (top-level rows)
        F.min(F.when(F.col("is_kw"), F.struct(F.col("pos"), tok.alias("kw"), n1.alias("name")))).alias("kw"),
        F.collect_list(F.when(top_ann, F.struct(F.col("pos"), n1.alias("name")))).alias("stereo_cands"),
        # member-level facts
        F.max(F.when(body, F.col("rname"))).alias("rname"),
        F.max(body).alias("has_body"),
        F.min(when_body(F.lit(True), F.col("off"))).alias("first_off"),
        F.max(when_body(F.lit(True), end)).alias("last_end"),
        F.max(when_body(F.lit(True), F.struct(F.col("pos"), tok.alias("t")))).alias("last_tok"),
        F.max(nested_kw).alias("has_kw"),
        F.min(F.when(hdr & (tok == "="), F.col("pos"))).alias("eq_pos"),
        F.min(F.when(name_cand, F.struct(F.col("pos"), tok.alias("name"), p1.alias("prev")))).alias("cand"),
        F.min(
            F.when(hdr & simple_ann & n1.isin(L.HTTP_MAPPINGS), F.struct(F.col("pos"), n1.alias("name")))
        ).alias("http"),
        F.collect_list(F.when(lit_cand, F.struct(F.col("pos"), F.col("ann_owner").alias("owner"), tok.alias("lit")))).alias("lits"),
        F.collect_list(F.when(call_row, F.struct(F.col("pos"), p1.alias("name")))).alias("call_list"),
        F.max(hdr & simple_ann & (n1 == L.AUTOWIRED)).alias("autowired"),
        F.min(F.when(hdr & ~modlike, F.struct(F.col("pos"), F.col("off"), tok.alias("t")))).alias("type_start"),
        F.collect_list(
            F.when(decl_cand, F.struct(F.col("pos"), (F.col("off") - F.col("ws_len")).alias("type_end")))
        ).alias("decls"),
    )


def _file_records(segs: DataFrame) -> DataFrame:
    """Per-file aggregation of segments: class name, stereotype, deps, methods."""
    cand = F.col("cand")
    is_method = (
        F.coalesce(F.col("has_body"), F.lit(False))
        & cand.isNotNull()
        & ~F.coalesce(F.col("has_kw"), F.lit(False))
        & (F.col("eq_pos").isNull() | (cand["pos"] < F.col("eq_pos")))
        # a constructor has only type parameters before its name
        & ~((cand["name"] == F.col("rname")) & (cand["prev"] == ">") & (F.col("type_start")["t"] == "<"))
    )
    endpoint_lit = F.array_min(F.filter("lits", lambda x: x["owner"] == F.col("http")["pos"]))["lit"]
    decl = F.array_min(F.filter("decls", lambda x: x["pos"] > F.col("type_start")["pos"]))
    is_field = (
        F.coalesce(F.col("has_body"), F.lit(False))
        & ~is_method
        & ~F.coalesce(F.col("has_kw"), F.lit(False))
        & F.coalesce(F.col("autowired"), F.lit(False))
        & (F.col("last_tok")["t"] == ";")
        & decl.isNotNull()
    )
    region_kw = F.col("kw")
    stereo = F.array_min(F.filter("stereo_cands", lambda x: x["pos"] < region_kw["pos"]))
    method_struct = F.struct(
        cand["pos"].alias("pos"),
        cand["name"].alias("name"),
        F.col("http")["name"].alias("http_method"),
        F.when(F.col("http").isNotNull(), F.regexp_replace(endpoint_lit, r'^"+|"+$', "")).alias("endpoint"),
        F.col("first_off").alias("first_off"),
        F.col("last_end").alias("last_end"),
        F.transform(F.array_sort("call_list"), lambda x: x["name"]).alias("calls"),
    )
    dep_struct = F.struct(
        F.col("type_start")["pos"].alias("pos"),
        F.col("type_start")["off"].alias("start"),
        decl["type_end"].alias("end"),
    )
    is_class_region = region_kw["kw"] == "class"
    return segs.groupBy(*FILE_KEY).agg(
        F.min(F.when(is_class_region, F.struct(region_kw["pos"].alias("pos"), region_kw["name"].alias("name"))))[
            "name"
        ].alias("first_class"),
        F.count_if(is_class_region).alias("n_classes"),
        F.min(F.when(is_class_region & stereo.isNotNull(), stereo))["name"].alias("stereotype"),
        F.collect_list(F.when(is_method, method_struct)).alias("m"),
        F.collect_list(F.when(is_field, dep_struct)).alias("d"),
    )


def parse(files: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """B11: files(path, content[, error]) -> parsed (one row per file, nothing dropped).  A null content is a failed
    file; its reason is ``error`` where the files come with one (B10)."""
    keyed = key_files(files, num_partitions)
    # rows that repeat a path and content are lexed once and share their record
    recs = _file_records(segments(token_table(keyed.dropDuplicates(FILE_KEY))))
    joined = keyed.join(recs, FILE_KEY, "left")
    content = F.col("content")
    stem = T.file_stem(T.file_name(F.col("path")))
    methods = F.transform(
        F.array_sort(F.col("m")),
        lambda x: F.struct(
            x["pos"].cast("bigint").alias("pos"),
            x["name"].alias("name"),
            x["http_method"].alias("http_method"),
            x["endpoint"].alias("endpoint"),
            F.substring(content, x["first_off"] + 1, x["last_end"] - x["first_off"]).alias("source_code"),
            x["calls"].alias("calls"),
        ),
    )
    deps = F.transform(
        F.array_sort(F.col("d")),
        lambda x: F.substring(content, x["start"] + 1, x["end"] - x["start"]),
    )
    error = F.when(content.isNull(), F.coalesce(F.col("error"), F.lit("unreadable file")))
    return joined.select(
        "path",
        F.coalesce(F.col("first_class"), stem).alias("class_name"),
        F.col("stereotype"),
        F.coalesce(F.when(error.isNull(), deps), F.array().cast("array<string>")).alias("autowired_deps"),
        F.coalesce(F.when(error.isNull(), methods), F.array().cast(f"array<{METHOD_STRUCT}>")).alias("methods"),
        error.alias("error"),
    )


def flat_methods(parsed: DataFrame) -> DataFrame:
    """One row per declared method of a successfully parsed file (overloads kept)."""
    return parsed.filter(F.col("error").isNull()).select(
        "path", "class_name", F.posexplode("methods").alias("ord", "m")
    ).select(
        "path",
        "class_name",
        F.col("m.pos").alias("pos"),
        (F.col("ord") + 1).cast("bigint").alias("ord"),
        F.col("m.name").alias("name"),
        F.col("m.http_method").alias("http_method"),
        F.col("m.endpoint").alias("endpoint"),
        F.col("m.source_code").alias("source_code"),
        F.col("m.calls").alias("calls"),
    )


def flat_deps(parsed: DataFrame) -> DataFrame:
    """One row per @Autowired field: (path, class_name, ord, dep)."""
    return parsed.filter(F.col("error").isNull()).select(
        "path", "class_name", F.posexplode("autowired_deps").alias("ord", "dep")
    ).select("path", "class_name", (F.col("ord") + 1).cast("bigint").alias("ord"), "dep")


def flat_calls(methods: DataFrame) -> DataFrame:
    """One row per call occurrence: caller (path, pos, name, class) -> callee name."""
    return methods.select(
        "path", "class_name", "pos", "ord", "name", F.posexplode("calls").alias("call_ord", "callee")
    ).withColumn("call_ord", (F.col("call_ord") + 1).cast("bigint"))
