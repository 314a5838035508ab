"""Lookups across fact tables: joins, anti joins, as-of and interval joins, recursion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage


def references(keys: DataFrame, refs: DataFrame, key: str, location: list[str]) -> DataFrame:
    """References of the keys, each location once."""
    return keys.select(key).distinct().join(refs, key).dropDuplicates(location)


def references_of(refs: DataFrame, name: str, location: list[str]) -> DataFrame:
    """References of a name; of a qualified one those of its bare name too, in all packages."""
    bare = name.rsplit("::", 1)[-1]
    return refs.filter(F.col("name").isin({name, bare})).select(*location).distinct()


def keyed_references(refs: DataFrame, symbols: DataFrame, package: str, name: str, sigil: str | None, location: list[str]) -> DataFrame:
    """References of a symbol key without its definition: a variable by sigil, or a routine by its qualified and (in main) bare name."""
    names = {f"{sigil}{name}"} if sigil else {f"{package}::{name}", *([name] if package == "main" else [])}
    defined = symbols.filter(F.col("name").isin(names) | F.col("qualified_name").isin(names)).select(*location)
    return refs.filter(F.col("name").isin(names)).select(*location).distinct().join(defined, location, "left_anti")


def unused(symbols: DataFrame, usages: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Symbols that no usage names. Definitions must have been filtered from usages."""
    named = usages.select(*[F.col(b).alias(f"_{b}") for _, b in on]).distinct()
    return symbols.join(named, reduce(lambda x, y: x & y, (F.col(a) == F.col(f"_{b}") for a, b in on)), "left_anti")


def usage_counts(refs: DataFrame, key: str, location: list[str]) -> DataFrame:
    """Distinct locations per key."""
    return refs.groupBy(key).agg(F.count_distinct(*location).alias("usages"))


#: More doublings than any chain of scopes has; only a cycle gets there.
MOST_DOUBLINGS = 40


def scope_ancestors(scopes: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(uri, id, ancestor, depth): each scope with itself (depth 0) and all scopes around it, or those within most_depth.

    Pointer doubling: each round joins the longest pairs with all, so a chain
    of length n takes log2(n) rounds, and each round's pairs are written before
    the next. Rounds end when one finds nothing; a cycle raises an error.
    """
    found = storage.settled(lambda: _doubled(scopes, most_depth), "ancestors")
    return found if most_depth is None else found.filter(F.col("depth") <= most_depth)


def _doubled(scopes: DataFrame, most_depth: int | None) -> DataFrame:
    pairs = scopes.select("uri", "id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    links = storage.staged(scopes.filter("parent is not null").select("uri", "id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")), "ancestors-1")
    for doubling in range(MOST_DOUBLINGS):
        reach = 1 << doubling
        if most_depth is not None and reach >= most_depth:
            break
        next_ = links.select("uri", F.col("id").alias("ancestor"), F.col("ancestor").alias("_far"), F.col("depth").alias("_more"))
        farther = links.filter(F.col("depth") == reach).join(next_, ["uri", "ancestor"]).select("uri", "id", F.col("_far").alias("ancestor"), (F.col("depth") + F.col("_more")).alias("depth"))
        farther = storage.staged(farther, f"ancestors-{reach}")
        size = farther.agg(F.count("*").alias("rows"), F.max(F.col("id") == F.col("ancestor")).alias("around")).first()
        if not size["rows"]:
            break
        if size["around"]:
            raise ValueError("scopes lie around themselves")
        links = links.union(farther)
    return pairs.union(links)


#: The depth of what is seen whatever scope it is in: farther than any other.
OUTERMOST = 1 << 30


def resolve_in_scopes(lookups: DataFrame, symbols: DataFrame, scopes: DataFrame, most_depth: int | None = None) -> DataFrame:
    """Symbols that lookups(uri, name, kind, scope_id) see, nearest scope first; `our` symbols are seen from scopes that are not packages.

    Symbols of the outermost scope, 0, are seen everywhere.
    """
    chain = scope_ancestors(scopes, most_depth)
    seen = lookups.join(chain.withColumnRenamed("id", "scope_id"), ["uri", "scope_id"])
    own = symbols.select("uri", "name", "kind", F.col("scope_id").alias("ancestor"), F.col("declaration"), F.col("sb").alias("symbol_sb"))
    direct = seen.join(own, ["uri", "name", "kind", "ancestor"])
    ours = own.filter("declaration = 'our'").drop("ancestor")
    around = scopes.filter("kind != 'Package'").select("uri", F.col("id").alias("scope_id"))
    shared = lookups.join(around, ["uri", "scope_id"], "left_semi").join(ours, ["uri", "name", "kind"]).withColumns({"ancestor": F.lit(None).cast("int"), "depth": F.lit(OUTERMOST)})
    return direct.unionByName(shared.select(*direct.columns))


def visible(symbols: DataFrame, uses: DataFrame, scopes: DataFrame, most_depth: int | None = None) -> DataFrame:
    """uses(uri, scope_id, ...) paired with the symbols of their scope, of a scope around it, or of scope 0."""
    chain = scope_ancestors(scopes, most_depth).select("uri", F.col("id").alias("scope_id"), F.col("ancestor").alias("_at"))
    everywhere = uses.select("uri", "scope_id").distinct().withColumn("_at", F.lit(0))
    reach = chain.unionByName(everywhere).distinct()
    return uses.join(reach, ["uri", "scope_id"]).join(symbols.withColumnRenamed("scope_id", "_at"), ["uri", "_at"]).drop("_at")


def as_of(points: DataFrame, changes: DataFrame, by: list[str], at: str, values: list[str], ties: int = 1) -> DataFrame:
    """points with the values of the last change at or before them; both tables have the columns `by` and `at`.

    A union and one window: one shuffle, no join. ties = 1 puts changes before
    points at the same place, -1 after them.
    """
    extra = [c for c in points.columns if c not in (*by, at)]
    left = points.select(*by, at, *extra, *[F.lit(None).cast(changes.schema[v].dataType).alias(v) for v in values], F.lit(1).alias("_point"))
    right = changes.select(*by, at, *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in extra], *values, F.lit(0).alias("_point"))
    order = Window.partitionBy(*by).orderBy(at, F.col("_point") * ties).rowsBetween(Window.unboundedPreceding, 0)
    packed = F.last(F.when(F.col("_point") == 0, F.struct(*values)), ignorenulls=True).over(order)
    rows = left.unionByName(right).withColumn("_value", packed).filter("_point = 1")
    return rows.select(*by, at, *extra, *[F.col(f"_value.{v}").alias(v) for v in values])


def containing(points: DataFrame, spans: DataFrame, position: str, start: str, end: str, by: list[tuple[str, str]], width: int, inclusive_end: bool = True) -> DataFrame:
    """Points with the spans around them: a range join.

    Spans are dealt to every cell of `width` they touch, and points to theirs,
    so the join is an equi join on by and cell.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    dealt = spans.withColumn("_cell", F.explode(F.sequence(cell(start), cell(end))))
    keys = reduce(lambda x, y: x & y, [F.col(a) == F.col(b) for a, b in by], cell(position) == F.col("_cell"))
    inside = (F.col(start) <= F.col(position)) & (F.col(position) <= F.col(end) if inclusive_end else F.col(position) < F.col(end))
    return points.join(dealt, keys & inside).drop("_cell")


def overlapping(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], by: list[tuple[str, str]], width: int) -> DataFrame:
    """Pairs of half-open spans that overlap, each once.

    Of two spans that overlap, one holds the start of the other: two range
    joins, in each of which only the holding side is dealt to its cells.
    """
    meet = (F.col(left_span[0]) < F.col(right_span[1])) & (F.col(right_span[0]) < F.col(left_span[1]))
    later = containing(right, left, right_span[0], *left_span, [(b, a) for a, b in by], width, inclusive_end=False)
    earlier = containing(left, right, left_span[0], *right_span, by, width, inclusive_end=False).filter(F.col(left_span[0]) > F.col(right_span[0]))
    columns = [*left.columns, *right.columns]
    return later.filter(meet).select(*columns).unionByName(earlier.filter(meet).select(*columns))


def subtypes(edges: DataFrame, parents: DataFrame, child: str, parent: str, key: str) -> DataFrame:
    return edges.join(parents.select(F.col(key).alias(parent)).distinct(), parent, "left_semi").select(child, parent).distinct()


def call_edges(calls: DataFrame, by: str, other: str, range_columns: list[str]) -> DataFrame:
    """Per pair of callables the number of calls and the first of them: incoming with by = callee, outgoing with by = caller."""
    return calls.groupBy(by, other).agg(F.count("*").alias("n_ranges"), F.min(F.struct(*range_columns)).alias("first_range"))


def call_ranges(calls: DataFrame, by: str, other: str, range_columns: list[str]) -> DataFrame:
    """A row for each call of a pair of callables, numbered in order within the pair."""
    place = F.row_number().over(Window.partitionBy(by, other).orderBy(*range_columns))
    return calls.select(by, other, *range_columns, place.alias("place"))


#: Include roots are a configured list; more than this many are refused.
MOST_ROOTS = 1_000


def first_hit(names: DataFrame, name: str, roots: DataFrame, existing: DataFrame) -> DataFrame:
    """Module names resolved over include roots(root, priority): the existing path with the first root. Each name has as many candidates as there are roots."""
    listed = sorted((r["priority"], r["root"]) for r in roots.select("root", "priority").limit(MOST_ROOTS + 1).collect())
    if len(listed) > MOST_ROOTS:
        raise ValueError(f"more than {MOST_ROOTS} include roots")
    relative = F.concat(F.regexp_replace(name, "::", "/"), F.lit(".pm"))
    candidates = F.array(*[F.struct(F.lit(i).alias("place"), F.concat(F.lit(f"{root}/"), relative).alias("path")) for i, (_, root) in enumerate(listed)])
    asked = names.select(name).distinct().select(name, F.explode(candidates).alias("_c")).select(name, "_c.*")
    found = asked.join(existing.select("path").distinct(), "path", "left_semi")
    return found.groupBy(name).agg(F.min_by("path", "place").alias("path"))


def compare_to_baseline(baseline: DataFrame, current: DataFrame, key: list[str], value: str, slower: float = 20.0, faster: float = -10.0) -> DataFrame:
    """Baseline rows with the current value, its change in percent and a status; keys only in current are left out."""
    now = current.select(*key, F.col(value).alias("current"))
    change = (F.col("current") - F.col("baseline")) / F.col("baseline") * 100
    status = F.when(F.col("current").isNull(), "missing").when(change > slower, "regression").when(change < faster, "faster").otherwise("ok")
    return baseline.select(*key, F.col(value).alias("baseline")).join(now, key, "left").withColumns({"pct_change": change, "status": status})


def diff(before: DataFrame, after: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison: added, removed, changed or same, with the values of both sides."""
    b = before.select(*key, *[F.col(v).alias(f"{v}_before") for v in values], F.lit(True).alias("_b"))
    a = after.select(*key, *[F.col(v).alias(f"{v}_after") for v in values], F.lit(True).alias("_a"))
    changed = reduce(lambda x, y: x | y, (~F.col(f"{v}_before").eqNullSafe(F.col(f"{v}_after")) for v in values))
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(changed, "changed").otherwise("same")
    return b.join(a, key, "full_outer").withColumn("change", kind).drop("_a", "_b")


def missing_keys(wanted: DataFrame, given: DataFrame, key: list[str]) -> DataFrame:
    """Keys, each once, that are wanted and not given."""
    return wanted.select(*key).distinct().join(given.select(*key).distinct(), key, "left_anti")


def resolved_threshold(rows: DataFrame, named: DataFrame, categories: DataFrame, default: float) -> DataFrame:
    """rows(category, name) with the threshold of the name, else of the category, else the default."""
    by_name = named.select("name", F.col("threshold").alias("_name"))
    by_category = categories.select("category", F.col("threshold").alias("_category"))
    return rows.join(by_name, "name", "left").join(by_category, "category", "left").withColumn("threshold", F.coalesce("_name", "_category", F.lit(default))).drop("_name", "_category")


def import_audit(imports: DataFrame, tokens: DataFrame, exports: DataFrame, pragmas: list[str]) -> dict[str, DataFrame]:
    """Unused, missing and duplicate imports, and all in canonical order.

    imports(uri, module, symbols, line), tokens(uri, text), exports(module,
    symbol). Pragmas are never unused; a bare import of a module with known
    exports is used if any of them is.
    """
    listed = imports.withColumn("symbol", F.explode_outer("symbols"))
    used = tokens.select("uri", F.col("text").alias("symbol")).distinct()
    unused_symbols = listed.filter("symbol is not null").join(used, ["uri", "symbol"], "left_anti").filter(~F.col("module").isin(pragmas)).select("uri", "module", "symbol", "line")
    bare = imports.filter(F.size("symbols") == 0).join(exports, "module").join(used, ["uri", "symbol"], "left")
    used_symbols = bare.join(used.withColumn("_used", F.lit(True)), ["uri", "symbol"], "left")
    idle = used_symbols.groupBy("uri", "module", "line").agg(F.max(F.coalesce("_used", F.lit(False))).alias("_any")).filter("not _any").select("uri", "module", F.lit(None).cast("string").alias("symbol"), "line")
    missing = used.join(exports, "symbol").join(imports.select("uri", "module"), ["uri", "module"], "left_anti").select("uri", "module", "symbol").distinct()
    duplicates = imports.groupBy("uri", "module").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("line")).alias("lines")).filter("n > 1")
    return {"unused": unused_symbols.unionByName(idle), "missing": missing, "duplicate": duplicates}


def dead_code(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Unused symbols by bare name, with a code of their kind."""
    idle = unused(symbols, refs.filter("kind != 'Definition'"), [("name", "name")])
    code = F.when(F.col("kind").isin("Subroutine", "Method"), "unused_subroutine").when(F.col("kind") == "Variable", "unused_variable").when(F.col("kind") == "Constant", "unused_constant").when(F.col("kind") == "Package", "unused_package").otherwise("unused_symbol")
    return idle.withColumn("code", code)


def redeclarations(variables: DataFrame, scopes: DataFrame, most_depth: int | None = None) -> DataFrame:
    """variables(uri, name, scope_id, sb) that repeat a name of their scope ("redeclared") or of one around it ("shadows")."""
    first = Window.partitionBy("uri", "scope_id", "name").orderBy("sb")
    ranked = variables.withColumn("_n", F.row_number().over(first))
    again = ranked.filter("_n > 1").drop("_n").withColumn("issue", F.lit("redeclared"))
    kept = ranked.filter("_n = 1").drop("_n")
    chain = scope_ancestors(scopes, most_depth).filter("depth > 0").select("uri", F.col("id").alias("scope_id"), F.col("ancestor"))
    outer = kept.select("uri", "name", F.col("scope_id").alias("ancestor"), F.col("sb").alias("_sb"))
    hidden = kept.join(chain, ["uri", "scope_id"]).join(outer, ["uri", "name", "ancestor"]).filter("_sb < sb").select(*variables.columns).distinct().withColumn("issue", F.lit("shadows"))
    return again.unionByName(hidden)


def unused_variables(variables: DataFrame, refs: DataFrame) -> DataFrame:
    """Variables but those of `our` and those that start with an underscore, which no reference in their file names."""
    own = variables.filter((F.coalesce("declaration", F.lit("my")) != "our") & ~F.col("name").rlike(r"^[$@%]?_"))
    return own.join(refs.select("uri", "name").distinct(), ["uri", "name"], "left_anti")


def lacking(files: DataFrame, uses: DataFrame, modules: list[str]) -> DataFrame:
    """(uri, module): files that do not use one of the modules."""
    wanted = files.select("uri").distinct().withColumn("module", F.explode(F.array(*map(F.lit, modules))))
    return wanted.join(uses.select("uri", "module").distinct(), ["uri", "module"], "left_anti")
