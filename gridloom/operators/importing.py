"""From buildings to solids: rings, footprints, heights, edges; import states and their commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.projection import FOOT, feet
from gridloom.functions.text import blank
from gridloom.operators.store import KeyedStore

# The least height and that of buildings without one (metres), the shortest edge (feet), names in a preview.
LEAST_HEIGHT, DEFAULT_HEIGHT = 3.0, 10.0
SHORTEST_EDGE = 1e-9
PREVIEW_NAMES = 24


def open_ring(ring: Column) -> Column:
    """A ring without its last point if that is the first again."""
    closed = (F.size(ring) > 1) & (F.try_element_at(ring, F.lit(1)) == F.try_element_at(ring, F.lit(-1)))
    return F.when(closed, F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def shown_name(name: Column, own_id: Column) -> Column:
    return F.when(blank(name), own_id).otherwise(name)


def height(ring: Column) -> Column:
    """A ring's extent in z, metres; what is 3 m or lower counts as 10 m."""
    z = F.transform(ring, lambda p: p["z"])
    tall = F.greatest(F.lit(LEAST_HEIGHT), F.array_max(z) - F.array_min(z))
    return F.when(tall <= LEAST_HEIGHT, DEFAULT_HEIGHT).otherwise(tall)


def plan_solids(buildings: DataFrame, anchors: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """Solids of `buildings` (building_id, name, epsg_code, ring) at their anchors (epsg, easting, northing, x, y, z).

    The two meet on `keys`. A building in another CRS than its anchor's is an error, or left out if not `strict`; one that
    names none counts as in the anchor's. Rings of fewer than three points are left out. Lengths are in feet.
    """
    clash = F.col("epsg_code").isNotNull() & (F.col("epsg_code") != F.col("epsg"))
    rows = buildings.join(anchors, keys).withColumn("ring", open_ring(F.col("ring")))
    if strict:
        ring = F.when(clash, F.raise_error(F.concat(F.lit("the file's CRS is not the project's: EPSG:"), F.col("epsg_code").cast("string"))).cast(rows.schema["ring"].dataType)).otherwise(F.col("ring"))
        rows = rows.withColumn("ring", ring)
    else:
        rows = rows.filter(~F.coalesce(clash, F.lit(False)))
    rows = rows.filter(F.size("ring") >= 3)
    point = lambda p: F.struct((F.col("x") + (p["x"] - F.col("easting")) / FOOT).alias("x_feet"), (F.col("y") + (p["y"] - F.col("northing")) / FOOT).alias("y_feet"))
    return rows.select(
        *keys, F.col("building_id").alias("source_id"), shown_name(F.col("name"), F.col("building_id")).alias("name"), F.transform("ring", point).alias("footprint"), F.col("z").alias("base_feet"), feet(height(F.col("ring"))).alias("height_feet")
    )


def footprint_edges(solids: DataFrame, *keys: str) -> DataFrame:
    """`keys`, pos, x1, y1, x2, y2: the sides of each footprint; sides of no length are left out."""
    f = F.col("footprint")
    turned = F.concat(F.slice(f, F.lit(2), F.greatest(F.size(f) - 1, F.lit(0))), F.slice(f, 1, 1))
    sides = F.zip_with(f, turned, lambda a, b: F.struct(a["x_feet"].alias("x1"), a["y_feet"].alias("y1"), b["x_feet"].alias("x2"), b["y_feet"].alias("y2")))
    long_enough = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)) > SHORTEST_EDGE
    rows = solids.select(*keys, F.posexplode(sides).alias("pos", "s")).select(*keys, "pos", "s.x1", "s.y1", "s.x2", "s.y2")
    return rows.filter(long_enough)


def merged_tiles(tiles: Column, new: Column) -> Column:
    """Imported tile ids with a new one at the end, unless it is blank or there."""
    known = F.coalesce(tiles, F.array().cast("array<string>"))
    return F.when(blank(new) | F.array_contains(known, new), known).otherwise(F.array_append(known, new))


def preview_names(rows: DataFrame, group: str, order: str, name: Column) -> DataFrame:
    """(group, pos, name): the first names of a group that aren't blank, and a last row saying how many more rows there are.

    Ranks are cut at the limit within each partition first, so a large group isn't sorted in one task.
    """
    named = rows.select(group, order, name.alias("name")).filter(~blank(F.col("name")))
    first = named.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("pos") <= PREVIEW_NAMES)
    total = rows.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    shown = total.join(first.groupBy(group).agg(F.count(F.lit(1)).alias("shown")), group, "left").withColumn("shown", F.coalesce("shown", F.lit(0)))
    more = shown.filter("total > shown").select(group, (F.col("shown") + 1).cast("int").alias("pos"), F.concat(F.lit("... and "), (F.col("total") - F.col("shown")).cast("string"), F.lit(" more")).alias("name"))
    return first.select(group, "pos", "name").unionByName(more)


def merged_import_state(state: Column, tile: Column, at: Column, path: Column, source: Column, count: Column) -> Column:
    """An import's state after one more file: struct(tiles, last_at, last_path, last_source, last_count)."""
    return F.struct(merged_tiles(state["tiles"], tile).alias("tiles"), at.alias("last_at"), path.alias("last_path"), source.alias("last_source"), count.alias("last_count"))


def import_summary(state: Column) -> Column:
    """An import in one line, from its state."""
    file = F.regexp_replace(state["last_path"], r"^.*[/\\]", "")
    tiles = F.when(F.size(state["tiles"]) == 0, "no tile id").otherwise(F.concat(F.lit("tiles "), F.array_join(state["tiles"], ", ")))
    return F.concat(state["last_count"].cast("string"), F.lit(" elements from "), file, F.lit(" at "), state["last_source"], F.lit("; "), tiles)


def file_rows(files: DataFrame) -> DataFrame:
    """source_path, seq, label, value: what a file's preview says, from source_path, srs_name, epsg_code, file_tile_id, buildings, solids, title, epsg, crs_name."""
    text = lambda c, none: F.when(blank(F.col(c)), none).otherwise(F.col(c))
    rows = (
        ("file", F.col("source_path")),
        ("declared system", text("srs_name", "none")),
        ("EPSG code", F.coalesce(F.col("epsg_code").cast("string"), F.lit("none"))),
        ("tile", text("file_tile_id", "none")),
        ("buildings", F.col("buildings").cast("string")),
        ("solids", F.col("solids").cast("string")),
        ("anchor", F.col("title")),
        ("anchor's system", F.format_string("EPSG:%s  %s", "epsg", "crs_name")),
    )
    array = F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(n).alias("label"), v.alias("value")) for i, (n, v) in enumerate(rows)))
    return files.select("source_path", F.inline(array))


# --- imports as commits ---


def import_outcome(rows: DataFrame) -> DataFrame:
    """`rows` (supported, read_only, solids) with `outcome`: imported, or why not."""
    why = F.when(~F.col("supported"), "unsupported").when(F.col("read_only"), "read-only").when(F.col("solids") == 0, "nothing to import").otherwise("imported")
    return rows.withColumn("outcome", why)


def import_history(imports: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """project_id, state: what many imports (project_id, at, seq, tile, path, source, count) leave, as if file by file in the order of (at, seq).

    `states` (project_id, state) is what was there before. The first place of each tile and the last import of each
    project are found by partial minima and maxima, so a project with very many imports isn't sorted in one task; what meets
    in one row is a project's distinct tiles.
    """
    order = F.struct("at", "seq")
    tiles = imports.filter(~blank(F.col("tile"))).groupBy("project_id", "tile").agg(F.min(order).alias("first"))
    facts = F.struct(F.col("at").alias("last_at"), F.col("path").alias("last_path"), F.col("source").alias("last_source"), F.col("count").alias("last_count"))
    last = imports.groupBy("project_id").agg(F.max_by(facts, order).alias("last"))
    if states is not None:
        # what was there stands before anything new: its order has no time
        none = F.lit(None).cast(imports.schema["at"].dataType)
        known = states.select("project_id", F.posexplode("state.tiles").alias("pos", "tile")).select("project_id", "tile", F.struct(none.alias("at"), F.col("pos").cast(imports.schema["seq"].dataType).alias("seq")).alias("first"))
        tiles = tiles.unionByName(known).groupBy("project_id", "tile").agg(F.min("first").alias("first"))
        was = states.select("project_id", F.struct("state.last_at", "state.last_path", "state.last_source", "state.last_count").alias("was"))
        last = last.join(was, "project_id", "full").select("project_id", F.coalesce("last", "was").alias("last"))
    listed = tiles.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("first", "tile"))).alias("t"))
    tiles_of = F.coalesce(F.transform("t", lambda t: t["tile"]), F.array().cast("array<string>"))
    state = F.struct(tiles_of.alias("tiles"), "last.last_at", "last.last_path", "last.last_source", "last.last_count")
    return last.join(listed, "project_id", "left").select("project_id", state.alias("state"))


STATE = "tiles array<string>, last_at timestamp, last_path string, last_source string, last_count int"


def commit_imports(imports: DataFrame, elements: DataFrame, store: KeyedStore, commit_id: str) -> int:
    """Publish imports (of `import_outcome`, with project_id, at, seq, tile, path, source, count) that were possible, and their elements
    (project_id, path, source_id, and more), as one commit: elements and import states, or neither. Its version.
    """
    base = store.snapshot()
    if commit_id in base.ids:
        return base.ids[commit_id]
    done = imports.filter("outcome = 'imported'")
    asked = done.select(F.col("project_id").cast("string").alias("key"), "project_id").distinct()
    there = store.get("imports", asked, base).join(asked, "key").select("project_id", F.from_json("value", STATE).alias("state"))
    states = import_history(done, there).select(F.col("project_id").cast("string").alias("key"), F.to_json("state").alias("value"))
    kept = elements.join(done.select("project_id", "path").distinct(), ["project_id", "path"], "left_semi")
    key = F.concat_ws("/", F.col("project_id").cast("string"), F.sha2("path", 256), "source_id")
    rest = [c for c in elements.columns if c not in ("project_id", "path", "source_id")]
    return store.commit(commit_id, {"elements": kept.select(key.alias("key"), F.to_json(F.struct("project_id", "path", "source_id", *rest)).alias("value")), "imports": states}, base)


def load_import_states(store: KeyedStore, kind: str = "long") -> DataFrame:
    """project_id, state of all projects with imports."""
    return store.read("imports").select(F.col("key").cast(kind).alias("project_id"), F.from_json("value", STATE).alias("state"))
