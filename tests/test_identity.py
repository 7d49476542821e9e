"""Identities against a plain recount with dictionaries and medians."""

import math
import random
from collections import defaultdict
from statistics import median

from tidemark.operators import identity

SCHEMA = "m long, ms long, track long, end string, area double, court_x double, appearance array<double>"


def unit(v):
    size = max(math.sqrt(sum(x * x for x in v)), 1e-9)
    return [x / size for x in v]


def middle(rows):
    looks = [r[6] for r in rows if r[6]]
    return unit([median(c) for c in zip(*looks)]) if looks else None


def brute(rows, per_end, most=0.22):
    """Track to slot (or None) for the tracks that keep to one end."""
    tracks = defaultdict(list)
    for r in rows:
        if r[2] is not None:
            tracks[r[2]].append(r)
    home = {}
    for t, own in tracks.items():
        near = sum(r[3] == "near" for r in own)
        if max(near, len(own) - near) / len(own) >= 0.8:
            home[t] = "near" if 2 * near >= len(own) else "far"
    good = [r for r in rows if home.get(r[2]) == r[3]]
    picks = []
    for ms in {r[1] for r in good}:
        ends = [sorted((r for r in good if r[1] == ms and r[3] == e), key=lambda r: (-r[4], r[2]))[:per_end] for e in ("near", "far")]
        if all(len(e) == per_end for e in ends):
            picks.append((sum(r[4] for e in ends for r in e), -ms, ends))
    if picks:
        ends = max(picks, key=lambda p: p[:2])[2]
        chosen = [(r[2], r[3]) for e in ends for r in sorted(e, key=lambda r: r[5])]
    else:
        chosen = []
        for e in ("near", "far"):
            on = {t: [r for r in own if r[3] == e] for t, own in tracks.items() if home.get(t) == e}
            best = sorted(on, key=lambda t: (len(on[t]), max(r[4] for r in on[t]), t), reverse=True)[:per_end]
            chosen += sorted(((t, e) for t in best), key=lambda x: max(on[x[0]], key=lambda r: r[4])[5])
        if len(chosen) != 2 * per_end or sum(e == "near" for _, e in chosen) != per_end:
            chosen = []
    slot = {t: i for i, (t, _) in enumerate(chosen)}
    members = [[r for r in tracks[t] if r[3] == e] for t, e in chosen]
    times = [{r[1] for r in own} for own in members]
    for t in sorted(tracks, key=lambda t: (-len(tracks[t]), min(r[1] for r in tracks[t]), t)):
        look = middle(tracks[t])
        if t in slot or t not in home or look is None:
            continue
        mine = {r[1] for r in tracks[t]}
        options = []
        for i, (_, e) in enumerate(chosen):
            centre = middle(members[i])
            if centre and e == home[t] and not mine & times[i]:
                options.append((1 - max(-1, min(1, sum(a * b for a, b in zip(centre, look)))), i))
        if options and min(options)[0] <= most:
            i = min(options)[1]
            slot[t] = i
            members[i] += [r for r in tracks[t] if r[3] == chosen[i][1]]
            times[i] |= mine
    return {t: slot.get(t) for t in home}


def match(rng, m, per_end):
    """Tracks of a few people, cut into pieces, with some rows on the wrong end and some without an appearance."""
    rows, faces = [], [[rng.gauss(0, 1) for _ in range(6)] for _ in range(2 * per_end + 1)]
    for t in range(rng.choice([3, 8, 14])):
        who = rng.randrange(len(faces))
        end = ("near", "far")[who % 2]
        first, length = rng.randrange(20), rng.choice([1, 3, 6, 10])
        for ms in range(first, first + length):
            wrong = rng.random() < 0.08
            look = None if rng.random() < 0.1 else [x + rng.gauss(0, 0.25) for x in faces[who]]
            rows.append((m, ms * 500, t, ("far" if end == "near" else "near") if wrong else end, round(rng.random(), 6), rng.uniform(0, 10), look))
    return rows + [(m, 0, None, "near", 99.0, 1.0, faces[0])]


def test_assignment_equals_recount(spark):
    rng = random.Random(3)
    formats = {m: 1 + m % 2 for m in range(30)}
    rows = {m: match(rng, m, k) for m, k in formats.items()}
    seen = spark.createDataFrame([r for x in rows.values() for r in x], SCHEMA)
    kinds = spark.createDataFrame(list(formats.items()), "m long, per_end int")
    got = defaultdict(dict)
    for r in identity.assign_identities(seen, kinds, "m").collect():
        got[r.m][r.track] = r.slot
        assert r.purity >= 0.8 and (r.slot is None) == (r.distance is None)
    for m, own in rows.items():
        assert got[m] == brute(own, formats[m]), m
    slots = [s for x in got.values() for s in x.values()]
    assert None in slots and slots.count(0) > 20
    framed = {m for m, x in got.items() if any(s is not None for s in x.values())}
    assert len(framed) < 30 or len(framed) > 10
    assert identity.assign_identities(seen.limit(0), kinds, "m").count() == 0


def test_inspection_rows(spark):
    rows = [(1, i * 500, 1, "near", 10.0 - i, 1.0, [1.0, 0.0]) for i in range(6)] + [(1, 9000, 1, "near", 50.0, 1.0, [0.0, 1.0]), (1, 9500, 1, "near", 3.5, 1.0, None), (1, 0, 2, "far", 1.0, 1.0, [1.0, 0.0])]
    seen = spark.createDataFrame(rows, SCHEMA)
    found = identity.assign_identities(seen, spark.createDataFrame([(1, 1)], "m long, per_end int"), "m")
    got = sorted((r.slot, r["rank"], r.ms) for r in identity.inspection_rows(seen, found, "m").collect())
    assert got == [(0, 1, 0), (0, 2, 1000), (0, 3, 2000), (0, 4, 9500), (1, 1, 0)]
    (near, far) = sorted(identity.public_roster(found, identity.inspection_rows(seen, found, "m"), "m").collect(), key=lambda r: r.id)
    assert (near.id, near.team, near.tracks, near.thumbnails) == ("P1", "T1", [1], [0, 1000, 2000]) and (far.id, far.team, far.tracks, far.thumbnails) == ("P2", "T2", [2], [0])
