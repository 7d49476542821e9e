"""Serves and strokes out of pose rows: windows around each row, scored as columns, then suppressed.

Pose rows: actor_id, ms (integer milliseconds), court_x, court_y, actor_end, ready (boolean), knee (degrees),
associated (boolean: a racket at a wrist), racket_hand, and over_ratio (the higher wrist above the shoulder, in torso
lengths) and for each hand h in left, right: h_over, h_x, h_y (wrist, body-relative), h_speed, h_elbow. Missing measures are null. With a match
column in keys, matches run side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import TINY
from tidemark.operators import folds, islands
from tidemark.operators.ranges import band_pairs, by_key
from tidemark.sources.scratch import written

HANDS = ("left", "right")
COURT_LENGTH, COURT_WIDTH = 23.77, 10.97
NET = COURT_LENGTH / 2


@dataclass(frozen=True)
class Thresholds:
    """What a serve and a stroke have to reach. Times in milliseconds, lengths of the body in torso
    lengths, those of the court in metres, angles in degrees."""

    baseline: float = 1.5
    overhead: float = 0.25
    hand_speed: float = 0.65
    setup_span: float = 1.8
    serve_score: float = 0.66
    rise: float = 0.22
    follow: float = 0.18
    follow_side: float = 0.15
    knee_bend: float = 155.0
    leg_drive: float = 12.0
    setup_gap: int = 800
    setup_longest: int = 2500
    serve_apart: int = 1250
    stroke_pre: int = 450
    stroke_post: int = 500
    stroke_smooth: int = 180
    stroke_speed: float = 0.85
    backswing: float = 0.18
    stroke_follow: float = 0.18
    through: float = 0.38
    stroke_score: float = 0.66
    stroke_apart: int = 700
    serve_mask: int = 700
    episode_gap: int = 950
    net_zone: float = 3.5


# Weights of the parts of a serve's score and of a stroke's.
SERVE_WEIGHTS = {"overhead": 0.18, "rise": 0.17, "speed": 0.18, "follow": 0.10, "follow_side": 0.07, "load": 0.10, "drive": 0.08, "opposed": 0.06, "still": 0.04, "racket": 0.02}
STROKE_WEIGHTS = {"speed": 0.30, "backswing": 0.20, "follow": 0.20, "through": 0.15, "elbow": 0.10, "reversal": 0.05, "racket": 0.05}


def _frames(keys: list[str]):
    base = Window.partitionBy(*keys, "actor_id").orderBy("ms")
    return lambda a, b: base.rangeBetween(a, b)


def _full(part: Column) -> Column:
    return F.least(part, F.lit(1.0))


def _weigh(weights: dict[str, float], parts: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(weight) * parts[name]
    return total


def _baseline(y: Column, c: Thresholds) -> Column:
    return (y <= c.baseline) | (y >= COURT_LENGTH - c.baseline)


def _hands(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each hand, its measures as columns without the hand's name."""
    each = [F.struct(F.lit(h).alias("hand"), F.lit(i).alias("hand_no"), *(F.col(f"{h}_{c}").alias(c) for c in columns)) for i, h in enumerate(HANDS)]
    drop = [f"{h}_{c}" for h in HANDS for c in columns]
    return df.withColumn("_h", F.explode(F.array(*each))).select(*(c for c in df.columns if c not in drop), "_h.*")


def _step_back() -> Column:
    """What of a row tells where the motion of a later one began."""
    return F.struct("ms", "court_x", "court_y", "actor_end", "knee", *(f"{h}_over" for h in HANDS))


def serve_candidates(pose: DataFrame, opposed: DataFrame, keys: list[str], c: Thresholds = Thresholds()) -> DataFrame:
    """Every baseline row of a hand that is at its highest for 0.3 s around: the measures of the motion, whether
    its parts come in order, its score, and accepted; and where its setup begins, as of setup_start.

    opposed: keys, ms of the frames in which both ends are seen.
    """
    w = _frames(keys)
    pre, near, post = w(-1350, -100), w(-300, 300), w(80, 700)
    # Frames join the timeline as rows of no actor, to be counted in one window of all.
    both = pose.select(*keys, "actor_id", "ms", F.lit(0).alias("_o")).distinct().unionByName(opposed.select(*keys, F.lit(None).cast(pose.schema["actor_id"].dataType).alias("actor_id"), "ms", F.lit(1).alias("_o")))
    around = F.sum("_o").over(Window.partitionBy(*keys).orderBy("ms").rangeBetween(-450, 450)) if keys else F.sum("_o").over(Window.orderBy("ms").rangeBetween(-450, 450))
    seen = both.withColumn("opposed", around).filter("_o = 0").select(*keys, "actor_id", "ms", "opposed")
    rows = pose.dropna(subset=[*keys, "actor_id", "ms"])
    bent = (F.col("knee") <= c.knee_bend).cast("int")
    knees = [f(F.col("knee")).over(x) for x in (pre, w(0, 0), post) for f in (F.min, F.max)]
    mine = {h: (F.col("associated") & (F.col("racket_hand") == h)).cast("int") for h in HANDS}
    count = lambda x, over: F.coalesce(F.sum(x).over(over), F.lit(0))
    rows = rows.withColumns({
        "_back": F.collect_list(_step_back()).over(w(-c.setup_longest, 0)),
        "_pre_rows": F.count("*").over(pre),
        "load": count(F.col("ready").cast("int"), pre),
        "knee_bend": count(bent, pre),
        "leg_drive": F.coalesce(F.greatest(*knees[1::2]) - F.least(*knees[::2]), F.lit(0.0)),
        "span": F.greatest(F.max("court_x").over(pre) - F.min("court_x").over(pre), F.max("court_y").over(pre) - F.min("court_y").over(pre)),
        "_last_y": F.max(F.struct("ms", "court_y")).over(post)["court_y"],
        **{f"{h}_racket": count(mine[h], pre) + count(mine[h], near) + count(mine[h], post) for h in HANDS},
        **{f"{h}_top": F.max(f"{h}_over").over(near) for h in HANDS},
        **{f"{h}_low": F.min(f"{h}_over").over(pre) for h in HANDS},
        **{f"{h}_fast": F.coalesce(F.max(f"{h}_speed").over(near), F.lit(0.0)) for h in HANDS},
        **{f"{h}_after": F.collect_list(F.when(F.col(f"{h}_x").isNotNull(), F.struct(F.col(f"{h}_x").alias("x"), F.col(f"{h}_y").alias("y")))).over(post) for h in HANDS},
    })
    rows = rows.filter(_baseline(F.col("court_y"), c) & (F.col("_pre_rows") >= 2))
    toward = F.when(F.col("court_y") < NET, F.col("_last_y") - F.col("court_y")).otherwise(F.col("court_y") - F.col("_last_y"))
    rows = rows.withColumn("recovery", F.greatest(F.coalesce(toward, F.lit(0.0)), F.lit(0.0)))
    hand = _hands(rows, ["over", "x", "y", "speed", "elbow", "racket", "top", "low", "fast", "after"])
    hand = hand.filter((F.col("over") >= c.overhead) & (F.col("over") >= F.col("top")) & F.col("low").isNotNull() & F.col("x").isNotNull() & (F.size("after") > 0))
    away = lambda p: F.sqrt((p["x"] - F.col("x")) ** 2 + (p["y"] - F.col("y")) ** 2)
    hand = hand.withColumns({
        "rise": F.greatest(F.col("over") - F.col("low"), F.lit(0.0)),
        "follow": F.array_max(F.transform("after", away)),
        "follow_side": F.array_max(F.transform("after", lambda p: F.abs(p["x"] - F.col("x")))),
    })
    # Only candidates need to know of opposed frames: they meet the timeline without the lists they were made of.
    hand = setup_start(hand, c).drop("after").join(by_key(seen), [*keys, "actor_id", "ms"])
    drive = (F.col("leg_drive") >= c.leg_drive) | (F.col("recovery") >= 0.12) | (F.col("racket") > 0) | ((F.col("opposed") > 0) & (F.col("follow") >= 1.5 * c.follow))
    finish = (F.col("follow") >= c.follow) & ((F.col("follow_side") >= c.follow_side) | (F.col("racket") > 0) | (F.col("fast") >= 1.25 * c.hand_speed))
    ordered = (F.col("rise") >= c.rise) & (F.col("fast") >= c.hand_speed) & (F.col("load") + F.col("knee_bend") > 0) & finish & (F.col("span") <= c.setup_span) & drive
    parts = {
        "overhead": _full(F.col("over") / c.overhead),
        "rise": _full(F.col("rise") / c.rise),
        "speed": F.least(F.col("fast") / c.hand_speed, F.lit(1.8)) / 1.8,
        "follow": _full(F.col("follow") / c.follow),
        "follow_side": _full(F.col("follow_side") / c.follow_side),
        "load": F.least(F.col("load") + F.col("knee_bend"), F.lit(1)),
        "drive": _full(F.greatest(F.col("recovery") / 0.25, F.col("leg_drive") / c.leg_drive)),
        "opposed": _full(F.col("opposed") / 2.0),
        "still": F.greatest(F.lit(0.0), 1.0 - F.col("span") / c.setup_span),
        "racket": F.least("racket", F.lit(1)),
    }
    score = F.least(F.greatest(_weigh(SERVE_WEIGHTS, parts), F.lit(0.0)), F.lit(1.0))
    out = hand.withColumns({"ordered": ordered, "_raw": score})
    out = out.withColumns({"accepted": F.col("ordered") & (F.col("_raw") >= c.serve_score), "score": F.bround("_raw", 4)})
    half = F.when(F.col("court_x") < COURT_WIDTH / 2, "left").otherwise("right")
    return out.select(*keys, "actor_id", "ms", "hand", "hand_no", "actor_end", half.alias("half"), "over", "rise", F.col("fast").alias("speed"), "follow", "follow_side", "load", "knee_bend", "leg_drive", "recovery", "span", "opposed", "racket", "ordered", "score", "accepted", "court_x", "setup_ms", "setup_source")


def setup_start(candidates: DataFrame, c: Thresholds = Thresholds()) -> DataFrame:
    """candidates (with _back, their actor's rows of the last setup_longest) with setup_ms and setup_source: where the arm begins to load.

    Going back from the strike for at most setup_longest, rows count while none is more than setup_gap from
    the next, at the same end, at the baseline and near in x. With three rows of the hand the last one within
    0.03 of its lowest is the onset, or a knee bend up to 0.65 s before that; else setup_longest is taken.
    """
    rows = candidates.withColumn("_back", F.sort_array("_back", asc=False))
    shape = "struct<go:boolean,at:bigint,run:array<struct<ms:bigint,over:double,knee:double>>>"
    begin = F.struct(F.lit(True).alias("go"), F.col("ms").alias("at"), F.array().cast("array<struct<ms:bigint,over:double,knee:double>>").alias("run")).cast(shape)

    def step(a: Column, r: Column) -> Column:
        fine = (a["at"] - r["ms"] <= c.setup_gap) & (r["actor_end"] == F.col("actor_end")) & _baseline(r["court_y"], c) & (F.abs(r["court_x"] - F.col("court_x")) <= c.setup_span)
        over = F.when(F.col("hand") == "left", r["left_over"]).otherwise(r["right_over"])
        more = F.struct(F.lit(True).alias("go"), r["ms"].alias("at"), F.array_append(a["run"], F.struct(r["ms"].alias("ms"), over.cast("double").alias("over"), r["knee"].cast("double").alias("knee"))).alias("run")).cast(shape)
        stop = F.struct(F.lit(False).alias("go"), a["at"].alias("at"), a["run"].alias("run")).cast(shape)
        return F.when(~a["go"], a).when(fine, more).otherwise(stop)

    rows = rows.withColumn("_run", F.filter(F.aggregate("_back", begin, step)["run"], lambda r: r["over"].isNotNull()))
    low = F.array_min(F.transform("_run", lambda r: r["over"]))
    rows = rows.withColumn("_trough", F.array_max(F.transform(F.filter("_run", lambda r: r["over"] <= low + 0.03), lambda r: r["ms"])))
    loads = F.filter("_run", lambda r: (r["ms"] >= F.col("_trough") - 650) & (r["ms"] <= F.col("_trough")) & (r["knee"] <= c.knee_bend))
    onset = F.coalesce(F.array_min(F.transform(loads, lambda r: r["ms"])), F.col("_trough"))
    seen = F.size("_run") >= 3
    rows = rows.withColumns({"setup_ms": F.when(seen, onset).otherwise(F.greatest(F.col("ms") - c.setup_longest, F.lit(0))), "setup_source": F.when(seen, "observed").otherwise("fallback")})
    return rows.drop("_back", "_run", "_trough")


def serves(pose: DataFrame, opposed: DataFrame, keys: list[str], c: Thresholds = Thresholds()) -> DataFrame:
    """Serve candidates with their setup, of those less than serve_apart from a better one none. Better: accepted,
    then score; then the smaller actor, the earlier row, the left hand."""
    found = serve_candidates(pose, opposed, keys, c)
    place = Window.partitionBy(*keys).orderBy("actor_id", "ms", "hand_no")
    # Needed twice: kept, as the windows over all poses would be made twice too.
    found = written(found.withColumn("_i", F.row_number().over(place)).withColumn("_rank", F.col("score") + F.when(F.col("accepted"), 10).otherwise(0)))
    kept = folds.suppressed(found.select(*keys, "ms", "_rank", "_i"), keys, "ms", "_rank", "_i", c.serve_apart)
    return found.join(by_key(kept.select(*keys, "_i")), [*keys, "_i"], "left_semi").drop("_i", "_rank", "hand_no")


def _median(items: Column, field: str) -> Column:
    """The exact median of a field of an array of structs."""
    x = F.array_sort(F.transform(items, lambda r: r[field]))
    n = F.size(x)
    return (F.get(x, F.floor((n - 1) / 2).cast("int")) + F.get(x, F.floor(n / 2).cast("int"))) / 2


def stroke_proposals(pose: DataFrame, serve_times: DataFrame, keys: list[str], c: Thresholds = Thresholds()) -> DataFrame:
    """Every row whose wrist goes back, forward and through: actor, ms, action, hand, confidence and the measures.
    Rows within serve_mask of a serve (keys, ms) are left out, as are actors with fewer than five rows."""
    w = _frames(keys)
    own = Window.partitionBy(*keys, "actor_id")
    # Masked rows are found by their names alone, which join the timeline as rows that only tell: poses are shuffled once, for all windows, and before what
    # windows are made of is worked out. Masked rows stay for the windows of others.
    masks, names = serve_times.select(*keys, F.col("ms").alias("_sv")), pose.select(*keys, "actor_id", "ms").distinct()
    # Serves are the points, rows the bands around themselves; without keys a constant stands in for one.
    tag = keys or ["_k"]
    if not keys:
        names, masks = names.withColumn("_k", F.lit(1)), masks.withColumn("_k", F.lit(1))
    hit = band_pairs(masks, names, tag, "_sv", F.col("ms") - c.serve_mask, F.col("ms") + c.serve_mask, 4.0 * c.serve_mask).select(*keys, "actor_id", "ms").distinct()
    told = pose.withColumns({"_pose": F.lit(True), "_masked": F.lit(False)}).unionByName(hit.dropna().withColumns({"_pose": F.lit(False), "_masked": F.lit(True)}), allowMissingColumns=True)
    rows = told.withColumn("_masked", F.max("_masked").over(w(0, 0))).filter("_pose").drop("_pose")
    rows = rows.withColumn("_rows", F.count("*").over(own)).filter("_rows >= 5").drop("_rows")
    smooth = w(-c.stroke_smooth, c.stroke_smooth)
    seen = {h: F.col(f"{h}_x").isNotNull() & F.col(f"{h}_y").isNotNull() for h in HANDS}
    # A wrist that was not seen in the row itself is filled in from the rows around it.
    rows = rows.withColumns({f"{h}_s{a}": F.percentile(F.when(seen[h], F.col(f"{h}_{a}")), F.lit(0.5)).over(smooth) for h in HANDS for a in "xy"})
    order = own.orderBy("ms")
    pre, post = w(-c.stroke_pre, -80), w(80, c.stroke_post)
    made = {}
    for h in HANDS:
        x, y = F.col(f"{h}_sx"), F.col(f"{h}_sy")
        at = F.when(x.isNotNull(), F.struct(F.col("ms").alias("ms"), x.alias("x"), y.alias("y")))

        def speed(dt: Column, dx: Column, dy: Column) -> Column:
            return F.when((dt > 0) & (dt <= 350), F.sqrt(dx * dx + dy * dy) / (dt / 1000.0))

        back = speed(F.col("ms") - F.lag("ms").over(order), x - F.lag(x).over(order), y - F.lag(y).over(order))
        ahead = speed(F.lead("ms").over(order) - F.col("ms"), F.lead(x).over(order) - x, F.lead(y).over(order) - y)
        made |= {f"{h}_pre": F.sort_array(F.collect_list(at).over(pre)), f"{h}_post": F.collect_list(at).over(post), f"{h}_v": F.coalesce(F.greatest(back, ahead), F.lit(0.0)), f"{h}_el": F.percentile(F.col(f"{h}_elbow"), F.lit(0.5)).over(pre)}
    rows = rows.withColumns(made)
    rows = rows.filter("not _masked").drop("_masked")
    hand = _hands(rows, ["over", "x", "y", "speed", "elbow", "sx", "sy", "pre", "post", "v", "el"])
    whole = F.col("sx").isNotNull() & (F.size("pre") >= 2) & (F.size("post") > 0) & F.col("elbow").isNotNull()
    half = F.greatest(F.lit(1), F.floor(F.size("pre") / 2).cast("int"))
    early, loaded = F.slice("pre", F.lit(1), half), F.slice("pre", half + 1, F.size("pre"))
    hand = hand.withColumns({f"{n}{a}": _median(v, a) for n, v in (("e", early), ("l", loaded), ("a", F.col("post"))) for a in "xy"})
    vec = {n: (F.col(f"{p}x") - F.col(f"{q}x"), F.col(f"{p}y") - F.col(f"{q}y")) for n, p, q in (("prep", "l", "e"), ("go", "s", "l"), ("end", "a", "s"), ("all", "a", "l"))}
    size = {n: F.sqrt(a * a + b * b) for n, (a, b) in vec.items()}
    cos = lambda m, n: F.when(size[m] * size[n] > TINY, (vec[m][0] * vec[n][0] + vec[m][1] * vec[n][1]) / (size[m] * size[n])).otherwise(0.0)
    hand = hand.withColumns({
        "backswing": size["prep"], "forward": size["go"], "follow": size["end"], "through": size["all"],
        "sideways": F.abs(vec["all"][0]), "prep_cos": cos("prep", "go"), "follow_cos": cos("go", "end"), "_turn": vec["prep"][0] * vec["go"][0],
        "gain": F.coalesce(F.col("elbow") - F.col("el"), F.lit(0.0)),
    })
    g = F.col
    reversal = (g("prep_cos") <= -0.10) | (g("_turn") <= -0.025)
    top = g("over_ratio")
    overhead = (top >= 0.15) & (g("v") >= 0.90 * c.stroke_speed) & (g("backswing") >= 0.12) & (g("forward") >= 0.14) & (g("follow") >= c.stroke_follow) & (g("through") >= 0.30) & reversal & (g("follow_cos") >= -0.20)
    compact = (F.abs(g("court_y") - NET) <= c.net_zone) & (g("v") >= 0.85 * c.stroke_speed) & (g("backswing") >= 0.12) & (g("forward") >= 0.14) & (g("follow") >= 0.14) & (g("through") >= 0.30) & (g("elbow") >= 105.0) & (g("gain") >= 4.0) & reversal & (g("follow_cos") >= -0.15)
    ground = (g("v") >= c.stroke_speed) & (g("backswing") >= c.backswing) & (g("forward") >= 0.16) & (g("follow") >= c.stroke_follow) & (g("through") >= c.through) & (g("sideways") >= 0.24) & (g("elbow") >= 85.0) & reversal & (g("follow_cos") >= -0.25)
    parts = {
        "speed": F.least(g("v") / c.stroke_speed, F.lit(1.5)) / 1.5,
        "backswing": _full(g("backswing") / c.backswing),
        "follow": _full(g("follow") / c.stroke_follow),
        "through": _full(g("through") / c.through),
        "elbow": _full(g("elbow") / 150.0),
        "reversal": reversal.cast("int"),
        "racket": F.coalesce(g("associated"), F.lit(False)).cast("int"),
    }
    action = F.when(overhead, "overhead").when(compact, "compact").when(ground, "ground")
    score = F.least(F.greatest(_weigh(STROKE_WEIGHTS, parts), F.lit(0.0)), F.lit(0.99))
    hand = hand.withColumns({"action": F.when(whole & (score >= c.stroke_score), action), "_raw": score})
    # The condition stands above the ranking: pushed below it, it would repeat all the expressions it is made of.
    motion = g("backswing") + g("forward") + g("follow") + g("through")
    best = Window.partitionBy(*keys, "actor_id", "ms").orderBy(g("action").isNull(), g("_raw").desc(), motion.desc(), "hand_no")
    hand = hand.withColumn("_best", F.row_number().over(best)).filter("_best = 1 and action is not null")
    return hand.select(*keys, "actor_id", "ms", "actor_end", "action", "hand", F.bround("_raw", 4).alias("confidence"), *(F.bround(n, 4).alias(n) for n in ("backswing", "forward", "follow", "through", "prep_cos", "follow_cos")), F.bround("v", 4).alias("speed"), F.bround("gain", 2).alias("gain"))


def strokes(pose: DataFrame, serve_times: DataFrame, keys: list[str], c: Thresholds = Thresholds()) -> DataFrame:
    """Stroke episodes: proposals an actor makes less than stroke_apart from a surer one fall, the rest within
    episode_gap of each other are one. keys, actor_id, session, start, end, n, top (time of the surest)."""
    found = stroke_proposals(pose, serve_times, keys, c)
    by = [*keys, "actor_id"]
    kept = folds.suppressed(found.withColumn("_t", F.col("ms")), by, "ms", "confidence", "_t", c.stroke_apart)
    return islands.sessions(kept.select(*by, "ms", "confidence"), by, "ms", c.episode_gap, "ms", best="confidence")
