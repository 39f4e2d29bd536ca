"""Facts from looking at faces: judgement, roll-up, reliability and donors of open eyes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import expressions as X

FACES = "array<struct<b: array<double>, k: array<double>, e: string, l: string>>"


def faces(detail: Column) -> Column:
    return F.from_json(detail, FACES)


def largest_faces(found: Column, most: int = 12) -> Column:
    """The faces (b, ...) of largest area, at most `most`."""
    by_area = lambda a, b: F.when(X.box_area(a["b"]) > X.box_area(b["b"]), -1).when(X.box_area(a["b"]) < X.box_area(b["b"]), 1).otherwise(0)
    return F.slice(F.array_sort(found, by_area), 1, most)


def rolled_up(states: Column) -> Column:
    """(faces, eyes_closed, looking_away, note) of an array of (e, l)."""
    count = lambda f: F.size(F.filter(states, f))
    away = count(lambda s: s["l"] == "away")
    unclear = count(lambda s: (s["e"] == "unclear") & (s["l"] != "away"))
    say = lambda n, words: F.when(n > 0, F.concat(n.cast("string"), F.lit(words)))
    note = F.concat_ws(", ", say(unclear, " too small or unclear"), say(away, " turned away"))
    return F.struct(F.size(states).alias("faces"), count(lambda s: s["e"] == "closed").alias("eyes_closed"), away.alias("looking_away"), note.alias("note"))


def face_states(vision: DataFrame, model_suffix: str) -> DataFrame:
    """(path, i, state): each face that the model saw; away before the state of its eyes."""
    rows = vision.filter(F.endswith("model", F.lit(model_suffix)) & (F.col("faces") > 0)).select("path", F.posexplode(faces(F.col("detail"))).alias("i", "f"))
    return rows.select("path", "i", F.when(F.col("f.l") == "away", "away").otherwise(F.col("f.e")).alias("state"))


def seeded(seed: int, key: str) -> list[Column]:
    """An order by a seeded hash of a column."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)).cast("binary"))]


def sample(rows: DataFrame, n: int, seed: int, key: str = "path") -> DataFrame:
    """`n` rows by the order of a seeded hash: the same for the same seed, whatever the partitions."""
    return rows.orderBy(*seeded(seed, key), key).limit(n)


def take_members(grouped: DataFrame, vision: DataFrame, hashes: DataFrame) -> DataFrame:
    """(group_id, path, seen, closed, sharp) of members whose faces were looked at."""
    v = vision.filter("status = 'ok' and detail is not null").select("path", faces(F.col("detail")).alias("f"))
    rows = grouped.select("group_id", "path").join(v, "path").join(hashes.select("path", "sharp"), "path", "left")
    return rows.select("group_id", "path", F.size("f").alias("seen"), F.size(F.filter("f", lambda x: x["e"] == "closed")).alias("closed"), F.coalesce("sharp", F.lit(0.0)).alias("sharp"))


def take_groups(grouped: DataFrame, vision: DataFrame) -> DataFrame:
    """(group_id, faces, closed, first): groups with closed eyes."""
    v = vision.filter("status = 'ok' and detail is not null").select("path", F.json_array_length("detail").alias("n"), F.size(F.filter(faces(F.col("detail")), lambda x: x["e"] == "closed")).alias("closed"))
    return grouped.join(v, "path").groupBy("group_id").agg(F.sum("n").alias("faces"), F.sum("closed").alias("closed"), F.min("path").alias("first")).filter("closed > 0")


def take_base(members: DataFrame) -> DataFrame:
    """(group_id, base, reliable): the frame with the fewest closed eyes, then the sharpest, then by path.

    Not reliable: three faces or more of which over 70 % are closed.
    """
    order = F.struct("closed", (-F.col("sharp")).alias("s"), "path")
    reliable = ~((F.sum("seen") >= 3) & (F.sum("closed") > 0.7 * F.sum("seen")))
    return members.groupBy("group_id").agg(F.min_by("path", order).alias("base"), reliable.alias("reliable"))


def donors(needed: DataFrame, offered: DataFrame, most_move: float = 0.6) -> DataFrame:
    """(group_id, face, donor, distance): for each closed face the nearest open one of its group that fits in place and width.

    needed: (group_id, face, box); offered: (group_id, donor, box), in the pixels of the base frame.  Equal boxes of a group are
    one on either side.  Boxes are compared only by cells of their centres: for widths from 2 ** level to twice that, a cell is as
    wide as the largest move, so a donor is in the face's cell or next to it, and no pair that fits is left out.
    """
    width = F.col("box")[2] - F.col("box")[0]
    sized = lambda w: (w > 0) & (w < float("inf"))  # others never fit
    wanted = needed.select("group_id", "box").distinct().filter(sized(width)).withColumn("level", F.floor(F.log2(width)))
    other = F.col("other")[2] - F.col("other")[0]
    # The struct keeps a null donor the least, as it is among donors at one distance.
    spare = offered.groupBy("group_id", F.col("box").alias("other")).agg(F.min(F.struct("donor")).alias("x")).select("group_id", "other", "x.donor")
    # Widths of 0.7 to 1.4 times a face's are those of three levels at most; a little more, as logarithms are rounded.
    levels = F.sequence(F.floor(F.log2(other / 2.8) - 1e-6), F.floor(F.log2(other / 0.7) + 1e-6))
    spare = spare.filter(sized(other)).withColumn("level", F.explode(levels))
    # Places beyond the limit count as there: neighbours stay neighbours.
    size = F.pow(F.lit(2.0), F.col("level") + 1) * (max(most_move, 1e-9) * 1.000001)
    place = lambda box, c: F.floor(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), (box[c] + box[c + 2]) / 2 / size)))
    near = lambda c: F.explode(F.sequence(place(F.col("box"), c) - 1, place(F.col("box"), c) + 1))
    wanted = wanted.withColumn("cx", near(0)).withColumn("cy", near(1))
    spare = spare.withColumn("cx", place(F.col("other"), 0)).withColumn("cy", place(F.col("other"), 1))
    d = X.box_distance(F.col("box"), F.col("other"))
    ratio = other / width
    fits = (d < most_move * width) & (ratio > 0.7) & (ratio < 1.4)
    # A face's cells and levels tell its partners apart, so no row is met twice.
    best = wanted.join(spare.hint("merge"), ["group_id", "level", "cx", "cy"]).filter(fits).groupBy("group_id", "box").agg(F.min(F.struct(d.alias("distance"), "donor")).alias("x"))
    return needed.join(best, ["group_id", "box"]).groupBy("group_id", "face").agg(F.min("x").alias("x")).select("group_id", "face", "x.donor", "x.distance")
