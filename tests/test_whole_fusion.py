"""Every finding of a run takes part in the fusion."""

from tracelake.plans import catalog


def test_every_finding_is_fused(spark, sf):
    found = catalog.QUERIES["detect_findings"](spark, sf)
    by_run = {}
    for f in found.collect():
        by_run.setdefault(f.trace_id, []).append(f)
    assert max(map(len, by_run.values())) > 4
    points, rest = {}, {}
    for run in by_run.values():
        for weight, key in ((1.0, lambda f: f.pos), (0.5, lambda f: -f.confidence)):
            for i, f in enumerate(sorted(run, key=lambda f: (key(f), f.phase, f.event_id, f.mode_id))):
                at = (f.trace_id, f.event_id)
                points[at] = points.get(at, 0) + (len(run) - i) * weight
                rest[at] = rest.get(at, 1) * (1 - weight * f.confidence)
    assert {(r.trace_id, r.event_id): r.points for r in catalog.QUERIES["attribute_borda"](spark, sf).collect()} == points
    got = {(r.trace_id, r.event_id): r.confidence for r in catalog.QUERIES["attribute_noisy_or"](spark, sf).collect()}
    assert got.keys() == rest.keys() and all(abs(got[k] - 1 + rest[k]) < 2e-6 for k in got)
