"""Files of runs: cameras, states with covariances, scan tables, frames and images of a folder, and points written as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.plans.ranking import beside, ranked

#: Texts that count as true.
TRUE = ("1", "true", "yes", "y")
#: Points of one written file.
FILE_ROWS = 1_000_000


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, file, w, h, fl_x, fl_y, cx, cy, m00 .. m33) of the frames of camera JSON files.

    The focal length is fl_x, else from x_fov (degrees) or camera_angle_x (radians) and the width; fl_y is fl_x where it is
    absent. A frame's own values go before its file's. Frames without a 4 x 4 matrix are left out.
    """
    own = "w DOUBLE, h DOUBLE, fl_x DOUBLE, fl_y DOUBLE, cx DOUBLE, cy DOUBLE, x_fov DOUBLE, camera_angle_x DOUBLE"
    schema = f"{own}, frames ARRAY<STRUCT<file_path: STRING, transform_matrix: ARRAY<ARRAY<DOUBLE>>, {own.replace(' DOUBLE', ': DOUBLE')}>>"
    files = spark.read.schema(schema).option("multiLine", "true").json(path)
    f = files.select(F.col("_metadata.file_path").alias("path"), *[F.col(c).alias(f"all_{c}") for c in files.columns if c != "frames"], F.posexplode("frames").alias("idx", "fr"))
    pick = lambda c: F.coalesce(F.col(f"fr.{c}"), F.col(f"all_{c}"))
    focal = F.coalesce(pick("fl_x"), pick("w") / (2 * F.tan(F.radians(pick("x_fov")) / 2)), pick("w") / (2 * F.tan(pick("camera_angle_x") / 2)))
    m = F.flatten("fr.transform_matrix")
    out = f.filter(F.size(m) == 16).select("path", "idx", F.col("fr.file_path").alias("file"), pick("w").alias("w"), pick("h").alias("h"), focal.alias("fl_x"), F.coalesce(pick("fl_y"), focal).alias("fl_y"), F.coalesce(pick("cx"), pick("w") / 2).alias("cx"), F.coalesce(pick("cy"), pick("h") / 2).alias("cy"), *[F.get(m, F.lit(4 * i + j)).alias(f"m{i}{j}") for i in range(4) for j in range(4)])
    return out


def read_image_poses(spark: SparkSession, path: str) -> DataFrame:
    """(file, camera, m00 .. m23): camera-to-world poses of image lists in text (id qw qx qy qz tx ty tz camera name), which hold
    world-to-camera ones: the turn is transposed and the shift turned back. Other lines are left out."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).filter((F.size("f") == 10) & ~F.col("f")[0].startswith("#"))
    values = parts.select(F.col("f")[9].alias("file"), F.col("f")[8].try_cast("long").alias("camera"), *[F.col("f")[k].try_cast("double").alias(c) for k, c in enumerate(("w", "x", "y", "z", "tx", "ty", "tz"), 1)]).dropna()
    w, x, y, z = (F.col(c) for c in "wxyz")
    r = [
        [1 - 2 * (y * y + z * z), 2 * (x * y + w * z), 2 * (x * z - w * y)],
        [2 * (x * y - w * z), 1 - 2 * (x * x + z * z), 2 * (y * z + w * x)],
        [2 * (x * z + w * y), 2 * (y * z - w * x), 1 - 2 * (x * x + y * y)],
    ]  # the transpose
    shift = [-(a * F.col("tx") + b * F.col("ty") + c * F.col("tz")) for a, b, c in r]
    return values.select("file", "camera", *[v.alias(f"m{i}{j}") for i in range(3) for j, v in enumerate([*r[i], shift[i]])])


#: Where focal lengths and centre are among the parameters of a camera model.
CAMERA_MODELS = {"SIMPLE_PINHOLE": (0, 0, 1, 2), "SIMPLE_RADIAL": (0, 0, 1, 2), "PINHOLE": (0, 1, 2, 3), "OPENCV": (0, 1, 2, 3), "FULL_OPENCV": (0, 1, 2, 3), "RADIAL": (0, 1, 2, 3)}


def read_intrinsics(spark: SparkSession, path: str) -> DataFrame:
    """(camera, model, w, h, fl_x, fl_y, cx, cy) of camera lists in text (id model width height parameters). A model that is not known
    raises an error; comments and lines without numbers are left out."""
    f = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).filter((F.size("f") >= 7) & ~F.col("f")[0].startswith("#"))
    table = spark.createDataFrame([(m, *[4 + k for k in at]) for m, at in CAMERA_MODELS.items()], "model string, i0 int, i1 int, i2 int, i3 int")
    rows = f.select(F.col("f")[0].try_cast("long").alias("camera"), F.upper(F.col("f")[1]).alias("model"), F.col("f")[2].try_cast("double").alias("w"), F.col("f")[3].try_cast("double").alias("h"), "f").dropna(subset=["camera", "w", "h"])
    joined = rows.join(F.broadcast(table), "model", "left")
    if bad := joined.filter("i0 IS NULL").select("model").first():
        raise ValueError(f"camera model {bad['model']!r} is not known")
    values = [F.get("f", F.col(f"i{k}")).try_cast("double").alias(n) for k, n in enumerate(("fl_x", "fl_y", "cx", "cy"))]
    return joined.select("camera", "model", "w", "h", *values).dropna()


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, convention, t, x, y, z, xx, xy, xz, yy, yz, zz) of JSON files of states with covariances.

    A file whose frame or error convention is missing, or with a state of wrong shape, that is not finite or not later than the
    one before it, raises an error.
    """
    state = "STRUCT<timestamp: DOUBLE, position: ARRAY<DOUBLE>, covariance: ARRAY<ARRAY<DOUBLE>>>"
    files = spark.read.schema(f"metadata STRUCT<covariance_frame: STRING, error_convention: STRING>, states ARRAY<{state}>").option("multiLine", "true").json(path)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("metadata.covariance_frame").alias("frame"), F.col("metadata.error_convention").alias("convention"), F.posexplode("states").alias("idx", "s"))
    c = F.flatten("s.covariance")
    numbers = F.concat(F.array(F.col("s.timestamp")), F.col("s.position"), c)
    sound = (F.size("s.position") == 3) & (F.size("s.covariance") == 3) & (F.size(c) == 9) & ~F.exists(numbers, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    late = F.col("s.timestamp") > F.lag("s.timestamp").over(Window.partitionBy("path").orderBy("idx"))
    bad = F.when(F.col("frame").isNull() | F.col("convention").isNull(), "no frame or convention").when(~F.coalesce(sound, F.lit(False)), "a state of wrong shape or values").when(~F.coalesce(late, F.lit(True)), "states out of order")
    told = rows.withColumn("bad", bad)
    if first := told.filter("bad IS NOT NULL").select("path", "bad").first():
        raise ValueError(f"{first['path']}: {first['bad']}")
    pick = {"xx": 0, "xy": 1, "xz": 2, "yy": 4, "yz": 5, "zz": 8}
    return told.select("path", "frame", "convention", F.col("s.timestamp").alias("t"), *[F.get("s.position", F.lit(k)).alias(a) for k, a in enumerate("xyz")], *[F.get(c, F.lit(k)).alias(n) for n, k in pick.items()])


def read_scan_table(spark: SparkSession, path: str, numbers: tuple[str, ...], flags: tuple[str, ...] = ()) -> DataFrame:
    """A CSV table with a header, its columns as text but for `numbers` (null where they are none) and `flags` (true for TRUE)."""
    rows = spark.read.option("header", "true").csv(path)
    value: dict[str, Column] = {c: F.col(c).try_cast("double") for c in numbers if c in rows.columns}
    value |= {c: F.coalesce(F.lower(F.trim(c)).isin(*TRUE), F.lit(False)) for c in flags if c in rows.columns}
    return rows.withColumns(value)


def files_of(spark: SparkSession, path: str, suffixes: tuple[str, ...], recursive: bool = False) -> DataFrame:
    """(path, name, size) of the files under path with these suffixes, in any case, by name; only their entries are read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", F.col("length").alias("size"))
    named = listed.withColumn("name", F.regexp_extract("path", "[^/]+$", 0))
    return named.filter(F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*suffixes)).orderBy("path").select("path", "name", "size")


def frames_of(spark: SparkSession, path: str) -> DataFrame:
    """The scans of a folder: those of the first kind of bin, pcd and ply that it has, by name; no rows without any."""
    every = files_of(spark, path, ("bin", "pcd", "ply")).withColumn("kind", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    first = every.agg(F.min("kind").alias("kind"))  # bin, pcd, ply: in the order of their names
    return every.join(F.broadcast(first), "kind").orderBy("path").select("path", "name", "size")  # one row


def sound_poses(poses: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """(by, problem) of trajectories that are no good: fewer than `least` poses, times that repeat, values that are not finite;
    with a column `idx` (a pose's place in its file) also times that go back."""
    bad = F.lit(False)
    for c in ("t", "x", "y", "z"):
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    placed = "idx" in poses.columns
    rows = beside(poses, by, ["idx"], ["t"]) if placed else poses
    back = F.count_if(F.col("before.t") > F.col("t")) if placed else F.lit(0)
    told = rows.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("t").alias("times"), F.count_if(bad).alias("bad"), back.alias("back"))
    problem = F.when(F.col("bad") > 0, "values that are not finite").when(F.col("n") < least, f"fewer than {least} poses").when(F.col("back") > 0, "times that go back").when(F.col("times") < F.col("n"), "times that repeat")
    return told.select(*by, problem.alias("problem")).filter("problem IS NOT NULL")


def write_ply(cloud: DataFrame, path: str, rows: int = FILE_ROWS) -> None:
    """Points as text PLY, `rows` of them at most in each file (one folder a file), in the order of pid."""
    placed = ranked(cloud.select("pid", "x", "y", "z"), "pid", [], name="place").withColumn("file", F.floor(F.col("place") / rows))
    lines = placed.select("file", (F.col("place") + 1).alias("at"), F.concat_ws(" ", *[F.col(c).cast("string") for c in "xyz"]).alias("value"))
    fields = "\n".join(f"property double {c}" for c in "xyz")
    heads = placed.groupBy("file").agg(F.count("*").alias("n")).select("file", F.lit(-1).cast("long").alias("at"), F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), F.col("n").cast("string"), F.lit(f"\n{fields}\nend_header")).alias("value"))
    lines.union(heads).repartition("file").sortWithinPartitions("file", "at").drop("at").write.mode("overwrite").partitionBy("file").text(path)


def write_csv(cloud: DataFrame, path: str) -> None:
    """Points as CSV with a header, in as many files as there are partitions."""
    cloud.select("x", "y", "z").write.mode("overwrite").option("header", "true").csv(path)


def convert(spark: SparkSession, source: str, path: str, kind: str) -> int:
    """Writes the points of all PLY, PCD, BIN and LAS files under source as `kind` and returns how many there are: ply, pcd and las
    are binary, text-ply and csv are text."""
    from cairn.sources.clouds import read_points, write_points

    cloud = read_points(spark, source).withColumn("pid", F.xxhash64("path", "pid"))
    if kind in ("ply", "pcd", "las"):
        write_points(cloud, path, kind)
    elif kind == "text-ply":
        write_ply(cloud, path)
    elif kind == "csv":
        write_csv(cloud, path)
    else:
        raise ValueError(f"points are written as ply, pcd, las, text-ply or csv, not as {kind!r}")
    return cloud.count()


def known_files(spark: SparkSession, path: str) -> DataFrame:
    """The point files under path; an error where there are none of a known kind (empty files are none: Spark leaves them out)."""
    files = files_of(spark, path, ("ply", "pcd", "bin", "las", "csv"), recursive=True)
    if files.first() is None:
        raise ValueError(f"no point files under {path}")
    return files
