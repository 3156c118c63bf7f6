"""Schemas that drift between the files of a stream.

A catalogue of column lifespans is made from per-file metadata: one row per file and field with
the type of most of its values. Within a stream's field, files in sequence form islands; an
island's first file logs a start, the file after its last one logs an ending. A start and an
ending of one file under which the records delivered in both files hold the same values are one
renaming. Renamings form the alias table, and from it come the casts that bring all files into one
table without losing a value. Records are parsed once; only the catalogue and the records of files
with a possible renaming are ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, written
from ..tables import broadcast_if_fits

#: the form of a number in a string
NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?$"
KINDS = ("integer", "decimal", "string", "object", "array", "boolean")


def value_kind(value: Column) -> Column:
    """The kind of a JSON value held as a variant; null for a JSON null."""
    t = F.schema_of_variant(value)
    return (
        F.when(t == "BIGINT", "integer")
        .when(t.rlike(r"^DECIMAL\((19|[23][0-9]),0\)$"), "integer")
        .when(t.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "decimal")
        .when(t == "STRING", "string")
        .when(t.startswith("OBJECT"), "object")
        .when(t.startswith("ARRAY"), "array")
        .when(t == "BOOLEAN", "boolean")
    )


def records(rows: DataFrame) -> DataFrame:
    """stream_id, file_id, delivered_ts, row_no, record_kind, _key, _f MAP<STRING, STRUCT<k, t>>.

    Each payload is parsed once: k is the kind of a field's value, t its text, a string's without
    quotes, anything else's as JSON; both are null for a JSON null. A payload that is null, is no JSON object or repeats a key has a null map: it has no
    fields. _key is player_id with game_id or, where that is absent, requested_date; null if either is
    missing.
    """
    parsed = rows.select(
        "stream_id", "file_id", "delivered_ts", "row_no", "record_kind",
        F.expr("try_cast(try_parse_json(payload) as map<string, variant>)").alias("_m"),
    )
    told = F.transform_values("_m", lambda _, v: F.struct(value_kind(v).alias("k"), F.when(~F.is_variant_null(v), v.cast("string")).alias("t")))

    def text(name: str) -> Column:
        return F.get(F.array(F.col("_f")[name]["t"]), F.lit(0))

    key = F.concat(text("player_id"), F.lit("\x1f"), F.coalesce(text("game_id"), text("requested_date")))
    return parsed.withColumn("_f", told).select("stream_id", "file_id", "delivered_ts", "row_no", "record_kind", key.alias("_key"), "_f")


def reading(kind: Column, text: Column) -> Column:
    """The number that a value can be read as, as text, or null.

    Integers and decimals are read as they are, a string that is a number in its usual form (no blanks,
    no leading zeros) as that, an object as its ``value`` and an array as its only element, if that is
    a number or such a string.
    """
    inner = F.when(kind == "object", F.get_json_object(text, "$.value")).when(kind == "array", F.regexp_extract(text, r'^\["?([^,"\[\]{}]*)"?\]$', 1)).when(kind == "string", text)
    return F.when(kind.isin("integer", "decimal"), text).when(inner.rlike(NUMBER), inner)


def whole(kind: Column, text: Column) -> Column:
    """Whether a value's reading tells all of it: an object's does if it has no further member."""
    return (kind != "object") | text.rlike(r'^\{"value":[^,{}\[\]]*\}$')


def exact(number: Column) -> Column:
    """Whether the number is the same as a DOUBLE: short enough, or what the DOUBLE is written as."""
    digits = F.length(F.regexp_replace(F.regexp_replace(number, r"[eE].*$|[^0-9]", ""), "^0+", ""))
    return (F.length(number) <= 15) | (digits <= 15) | (number.cast("double").cast("string") == number)


def fits_long(kind: Column, number: Column) -> Column:
    """Whether the number, of a value of that kind, is told by a BIGINT: written without a point, and not too long."""
    return (kind != "decimal") & ((kind == "integer") | number.rlike("^-?[0-9]+$")) & ((F.length(number) <= 18) | number.try_cast("bigint").isNotNull())


def catalogue(parsed: DataFrame) -> DataFrame:
    """One row per file and field: stream_id, file_id, field, kind (null if null throughout), seq, files,
    and what the columns' types need: n (values), n_fraction (readings that no BIGINT holds), n_text
    (strings), n_truth (booleans), n_partial (values that a number does not tell exactly and wholly).

    seq is the file's place in its stream by (delivered_ts, file_id), files the stream's number of
    files. A tie of kinds goes to the first in KINDS. Files without a single readable record have
    one row with a null field, so that they keep their place.
    """
    exploded = parsed.select("stream_id", "file_id", "delivered_ts", F.explode_outer("_f").alias("field", "_v"))
    kind, text = F.col("_v.k"), F.col("_v.t")
    typed = exploded.select("stream_id", "file_id", "delivered_ts", "field", kind.alias("_k"), text.alias("_t"), reading(kind, text).alias("_r"))
    loose = F.col("_r").isNull() | ~whole(F.col("_k"), F.col("_t")) | ~F.coalesce(exact(F.col("_r")), F.lit(False))
    votes = typed.groupBy("stream_id", "file_id", "field").agg(
        F.min("delivered_ts").alias("delivered_ts"),
        *(F.count_if(F.col("_k") == k).alias(f"_n_{k}") for k in KINDS),
        F.count("_t").alias("n"),
        F.count_if(F.col("_r").isNotNull() & ~fits_long(F.col("_k"), F.col("_r"))).alias("n_fraction"),
        F.count_if(F.col("_t").isNotNull() & loose).alias("n_partial"),
    )
    best = F.greatest(*(F.struct(F.col(f"_n_{k}").alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(KINDS)))
    fields = votes.select(
        "stream_id", "file_id", "delivered_ts", "field", F.when(best["n"] > 0, best["k"]).alias("kind"),
        "n", "n_fraction", F.col("_n_string").alias("n_text"), F.col("_n_boolean").alias("n_truth"), "n_partial",
    )
    # a file's time is the least of all its rows; a null field beside others is a row without fields
    w = Window.partitionBy("stream_id", "file_id")
    fields = fields.withColumns({"delivered_ts": F.min("delivered_ts").over(w), "_any": F.count("field").over(w)}).where("field is not null or _any = 0").drop("_any")
    places = Window.partitionBy("stream_id").orderBy(F.col("delivered_ts").asc_nulls_first(), "file_id")
    seq = F.dense_rank().over(places)
    return fields.withColumn("seq", seq).withColumn("files", F.max("seq").over(Window.partitionBy("stream_id"))).drop("delivered_ts")


def lifespans(cat: DataFrame) -> DataFrame:
    """The islands of each stream's field: stream_id, field, first_seq, last_seq, files."""
    w = Window.partitionBy("stream_id", "field").orderBy("seq")
    real = cat.where("field is not null")
    first = real.withColumn("_start", F.coalesce(F.col("seq") != F.lag("seq").over(w) + 1, F.lit(True)))
    starts = first.withColumn("_island", F.sum(F.col("_start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return starts.groupBy("stream_id", "field", "_island").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max("files").alias("files")).drop("_island")


def aliases(parsed: DataFrame, cat: DataFrame, spans: DataFrame) -> DataFrame:
    """Renamings: stream_id, seq (of the file with the new name), old_field, new_field, one to one.

    Old and new name are paired if all records delivered in both files agree: both values missing
    (null or left out), or both present and equal, leaving aside records in which either value is
    not of its field's kind in its file. At least one pair of values must be present. A record that
    a file holds twice counts by each row. Should several pairs agree, each name is used once, in
    order of most agreeing records, then of names.
    """
    gone = spans.where("last_seq < files").select("stream_id", (F.col("last_seq") + 1).alias("seq"), F.col("field").alias("old_field"))
    come = spans.where("first_seq > 1").select("stream_id", F.col("first_seq").alias("seq"), F.col("field").alias("new_field"))
    # per file the fields that went after it (side 0) or came with it (side 1), where both happened at once
    ends = gone.select("stream_id", "seq", F.lit(0).alias("_side"), F.col("old_field").alias("field"))
    starts = come.select("stream_id", "seq", F.lit(1).alias("_side"), F.col("new_field").alias("field"))
    both = Window.partitionBy("stream_id", "seq")
    asked = ends.unionByName(starts).withColumns({"_least": F.min("_side").over(both), "_most": F.max("_side").over(both)}).where("_least < _most")
    at = F.expr("a.stream_id = k.stream_id and a.field = k.field and a.seq + a._side - 1 = k.seq")
    named = asked.alias("a").join(cat.alias("k"), at).select("k.file_id", "a.stream_id", "a.seq", "a._side", "a.field", "k.kind")
    listed = cut(named.groupBy("stream_id", "file_id").agg(F.collect_list(F.struct("seq", "_side", "field", "kind")).alias("_names")))
    # one pass over the records of the listed files: each listed field's value, or null
    found = parsed.where("_f is not null and _key is not null").join(broadcast_if_fits(listed, 100_000), ["stream_id", "file_id"]).select("stream_id", "_key", "_f", F.explode("_names").alias("_n"))
    v = F.get(F.array(F.col("_f")[F.col("_n.field")]), F.lit(0))
    values = found.select("stream_id", "_key", F.col("_n.seq").alias("seq"), F.col("_n._side").alias("_side"), F.col("_n.field").alias("field"), v["t"].alias("text"), (v["k"] != F.col("_n.kind")).alias("stray"))
    old = values.where("_side = 0").select("stream_id", "seq", "_key", F.col("field").alias("old_field"), F.col("text").alias("old_text"), F.col("stray").alias("old_stray"))
    new = values.where("_side = 1").select("stream_id", "seq", "_key", F.col("field").alias("new_field"), F.col("text").alias("new_text"), F.col("stray").alias("new_stray"))
    pairs = old.join(new, ["stream_id", "seq", "_key"])
    aside = F.coalesce(F.col("old_stray"), F.lit(False)) | F.coalesce(F.col("new_stray"), F.lit(False))
    same = pairs.groupBy("stream_id", "seq", "old_field", "new_field").agg(
        F.count_if(~aside & ~F.col("old_text").eqNullSafe(F.col("new_text"))).alias("_unlike"),
        F.count_if(~aside & (F.col("old_text") == F.col("new_text"))).alias("_like"),
    )
    fit = same.where("_unlike = 0 and _like > 0")
    # a one-to-one choice: repeated for pairs whose names are both still free
    order = F.struct((-F.col("_like")).alias("a"), F.col("old_field").alias("b"), F.col("new_field").alias("c"))
    lists = fit.groupBy("stream_id", "seq").agg(F.array_sort(F.collect_list(order)).alias("_all"))
    empty = F.array().cast("array<struct<a:bigint,b:string,c:string>>")
    chosen = F.aggregate(
        "_all",
        empty,
        lambda done, x: F.when(F.exists(done, lambda y: (y["b"] == x["b"]) | (y["c"] == x["c"])), done).otherwise(F.concat(done, F.array(x.cast("struct<a:bigint,b:string,c:string>")))),
    )
    return lists.select("stream_id", "seq", F.explode(chosen).alias("_p")).select("stream_id", "seq", F.col("_p.b").alias("old_field"), F.col("_p.c").alias("new_field"))


def lineages(spans: DataFrame, renamed: DataFrame) -> DataFrame:
    """spans with canonical: the first name of the chain of renamings that a lifespan belongs to.

    Chains are shortened by pointer doubling, so the rounds grow with the logarithm of the longest.
    A chain that begins while another of that name goes on (the name was given up by a renaming and
    used anew) is told apart by the number of its first file.
    """
    node = spans.select("stream_id", "field", "first_seq", "last_seq", "files")
    edge = renamed.alias("r").join(node.alias("n"), F.expr("r.stream_id = n.stream_id and r.old_field = n.field and n.last_seq = r.seq - 1"))
    up = edge.select(F.col("r.stream_id").alias("stream_id"), F.col("new_field").alias("field"), F.col("r.seq").alias("first_seq"), F.col("n.field").alias("_to"), F.col("n.first_seq").alias("_to_seq"))
    links = cut(up)
    while True:
        over = links.alias("a").join(links.alias("b"), F.expr("a.stream_id = b.stream_id and a._to = b.field and a._to_seq = b.first_seq"), "left")
        links = cut(over.select("a.stream_id", "a.field", "a.first_seq", F.coalesce("b._to", "a._to").alias("_to"), F.coalesce("b._to_seq", "a._to_seq").alias("_to_seq"), F.col("b._to").isNotNull().alias("_moved")))
        if links.where("_moved").isEmpty():
            break
        links = links.drop("_moved")
    named = node.join(links.drop("_moved"), ["stream_id", "field", "first_seq"], "left").select("stream_id", "field", "first_seq", "last_seq", "files", F.coalesce("_to", "field").alias("canonical"), F.coalesce("_to_seq", "first_seq").alias("origin_seq"))
    ends = named.groupBy("stream_id", "canonical", "origin_seq").agg(F.max("last_seq").alias("_end"))
    before = F.max("_end").over(Window.partitionBy("stream_id", "canonical").orderBy("origin_seq").rowsBetween(Window.unboundedPreceding, -1))
    own = F.when(before >= F.col("origin_seq"), F.concat("canonical", F.lit("#"), F.col("origin_seq").cast("string"))).otherwise(F.col("canonical"))
    lanes = ends.select("stream_id", "canonical", "origin_seq", own.alias("_lane"))
    return named.join(lanes, ["stream_id", "canonical", "origin_seq"]).select("stream_id", "field", "first_seq", "last_seq", "files", F.col("_lane").alias("canonical"), "origin_seq")


class Drift:
    """The catalogue of a set of streams, and what follows from it.

    The records are parsed once, into a table in the shared folder; the catalogue and all that is made
    from it have a row per file and field at most.
    """

    def __init__(self, rows: DataFrame):
        self.parsed = written(records(rows))
        self.cat = cut(catalogue(self.parsed))
        self.spans = cut(lifespans(self.cat))
        self.renamed = cut(aliases(self.parsed, self.cat, self.spans))
        self.lines = cut(lineages(self.spans, self.renamed))

    def named(self) -> DataFrame:
        """The catalogue with each field's canonical name and origin, and its kind carried over null files."""
        inside = F.expr("c.stream_id = l.stream_id and c.field = l.field and c.seq between l.first_seq and l.last_seq")
        rows = self.cat.alias("c").join(self.lines.alias("l"), inside).select("c.*", "l.first_seq", "l.canonical", "l.origin_seq")
        w = Window.partitionBy("stream_id", "canonical", "origin_seq").orderBy("seq")
        return rows.withColumn("carried", F.last("kind", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_earlier", F.lag("carried").over(w))

    def changes(self) -> DataFrame:
        """file_id, change_kind, old_field, new_field: one row per change against the file before."""
        files = self.cat.select("stream_id", "seq", "file_id").distinct()
        starts = self.spans.where("first_seq > 1").select("stream_id", F.col("first_seq").alias("seq"), F.lit("added").alias("change_kind"), F.lit("").alias("old_field"), F.col("field").alias("new_field"))
        ends = self.spans.where("last_seq < files").select("stream_id", (F.col("last_seq") + 1).alias("seq"), F.lit("removed").alias("change_kind"), F.col("field").alias("old_field"), F.lit("").alias("new_field"))
        starts = starts.join(self.renamed.select("stream_id", "seq", "new_field"), ["stream_id", "seq", "new_field"], "left_anti")
        ends = ends.join(self.renamed.select("stream_id", "seq", "old_field"), ["stream_id", "seq", "old_field"], "left_anti")
        renames = self.renamed.withColumn("change_kind", F.lit("renamed"))
        retypes = self.named().where("kind is not null and _earlier is not null and kind != _earlier").select("stream_id", "seq", F.lit("retyped").alias("change_kind"), F.col("field").alias("old_field"), F.col("field").alias("new_field"))
        columns = ["stream_id", "seq", "change_kind", "old_field", "new_field"]
        log = starts.select(columns).unionByName(ends.select(columns)).unionByName(renames.select(columns)).unionByName(retypes.select(columns))
        return log.join(files, ["stream_id", "seq"]).select("file_id", "change_kind", "old_field", "new_field")

    def columns(self) -> list[tuple[str, str, bool]]:
        """(canonical name, Spark type, whether a raw column goes with it) of the one table, by name.

        A column is numeric if it is integer or decimal in any file: BIGINT if every number read in it
        fits one and none is written with a point, else DOUBLE. Otherwise it is BOOLEAN if it was
        nothing but boolean, or STRING. A raw column is needed where some value is not wholly and
        exactly told by that type. A table's columns have to fit its schema, so they are gathered
        whatever their number; there is no bound but Spark's own.
        """
        sums = [F.sum(c).alias(c) for c in ("n", "n_fraction", "n_text", "n_truth", "n_partial")]
        seen = self.named().groupBy("canonical").agg(F.max(F.coalesce(F.col("kind").isin("integer", "decimal"), F.lit(False))).alias("numeric"), *sums)
        out = []
        for r in seen.collect():
            if r.numeric:
                out.append((r.canonical, "double" if r.n_fraction else "bigint", r.n_partial > 0))
            elif r.n_truth == r.n > 0:
                out.append((r.canonical, "boolean", False))
            else:
                out.append((r.canonical, "string", r.n_text < r.n))
        return sorted(out)

    def placed(self) -> list[tuple[str, str, str, str | None]]:
        """(canonical name, type, column, raw column or None): names made different, letter case aside.

        A name that another one or one of the table's own columns has taken gets a number as suffix.
        """
        used = {"stream_id", "file_id", "row_no", "record_kind", "delivered_ts"}

        def free(name: str) -> str:
            at, k = name, 1
            while at.lower() in used:
                k += 1
                at = f"{name}_{k}"
            used.add(at.lower())
            return at

        out = [(name, kind, free(name), raw) for name, kind, raw in self.columns()]
        return [(name, kind, column, free(f"{column}__raw") if raw else None) for name, kind, column, raw in out]

    def unified(self) -> DataFrame:
        """All records in one table: stream, file, row and, per canonical name, a typed column.

        No value is lost or altered: each that is not null in a payload stands in its canonical column
        ``x``, or as JSON text in ``x__raw`` if that column's type cannot tell it. An object with a
        ``value`` beside other members has its number in ``x`` and its whole text in ``x__raw``. Rows
        whose payload cannot be read are kept, with nulls.
        """
        columns = self.placed()
        own = ["stream_id", "file_id", "row_no", "record_kind", "delivered_ts"]
        if not columns:
            return self.parsed.select(own)
        places = F.create_map(*(x for i, (name, kind, _, _) in enumerate(columns) for x in (F.lit(name), F.struct(F.lit(i).alias("i"), F.lit(kind).alias("to")))))
        placed = self.named().select("stream_id", "file_id", F.struct("field", places[F.col("canonical")].alias("at")).alias("_n"))
        names = placed.groupBy("stream_id", "file_id").agg(F.map_from_entries(F.collect_list("_n")).alias("_names"))
        rows = self.parsed.join(names, ["stream_id", "file_id"], "left")

        # a record's own values are read, and then put in the columns' places: neither the work on values
        # nor the code grows with the number of columns
        def placing(e: Column) -> Column:
            return F.struct(F.col("_names")[e["key"]].alias("at"), e["value"]["k"].alias("k"), e["value"]["t"].alias("t"))

        def read(v: Column) -> Column:
            return F.struct(v["at"]["i"].alias("i"), v["at"]["to"].alias("to"), v["k"].alias("k"), v["t"].alias("t"), F.when(v["at"]["to"].isin("bigint", "double"), reading(v["k"], v["t"])).alias("n"))

        def told(v: Column) -> Column:
            n = v["n"]
            holds = F.when(v["to"] == "bigint", fits_long(v["k"], n)).when(v["to"] == "double", exact(n)).when(v["to"] == "string", v["k"] == "string").otherwise(v["k"] == "boolean")
            fits = F.coalesce(holds, F.lit(False))
            quoted = F.when(v["k"] == "string", F.regexp_replace(F.to_json(F.array(v["t"])), r"^\[|\]$", "")).otherwise(v["t"])
            return F.struct(v["i"].alias("i"), F.struct(F.when(fits, F.coalesce(n, v["t"])).alias("x"), F.when(~fits | ~whole(v["k"], v["t"]), quoted).alias("raw")).alias("cell"))

        held = F.filter(F.map_entries("_f"), lambda e: e["value"]["t"].isNotNull())
        by_place = F.map_from_entries(F.transform(F.transform(F.transform(held, placing), read), told))
        cells = rows.select(*own, F.get(F.transform(F.array(by_place), lambda m: F.transform(F.sequence(F.lit(0), F.lit(len(columns) - 1)), lambda i: m[i])), F.lit(0)).alias("_c"))
        out = []
        for i, (_, kind, column, raw) in enumerate(columns):
            cell = F.get("_c", F.lit(i))
            out.append(cell["x"].cast(kind).alias(column))
            if raw:
                out.append(cell["raw"].alias(raw))
        return cells.select(*own, *out)

    def cells(self) -> DataFrame:
        """The one table's cells: stream_id, file_id, row_no, field (canonical), number, text, raw; one
        row per value that is not null, however many columns it takes. Truth values come as text."""
        parts = []
        for name, kind, column, raw in self.placed():
            at, none = F.col(f"`{column}`"), F.lit(None)
            number = at.cast("double") if kind in ("bigint", "double") else none.cast("double")
            text = at.cast("string") if kind not in ("bigint", "double") else none.cast("string")
            parts.append(F.struct(F.lit(name).alias("field"), number.alias("number"), text.alias("text"), (F.col(f"`{raw}`") if raw else none.cast("string")).alias("raw")))
        table = self.unified()
        each = F.array(*parts) if parts else F.array().cast("array<struct<field:string,number:double,text:string,raw:string>>")
        return table.select("stream_id", "file_id", "row_no", F.explode(each).alias("_c")).select("stream_id", "file_id", "row_no", "_c.*").where("number is not null or text is not null or raw is not null")
