import numpy as np
import pytest

from cairn.functions import particles as pf
from cairn.functions import states as st
from cairn.functions.grid import GridSettings, GridSmoother
from cairn.plans import blending as b


def well(n=160, cut=100, seed=0):
    rng = np.random.default_rng(seed)
    at = np.arange(9900.0, 10200, 0.5)
    curve = pf.Curve(at, 70 + 25 * np.sin(at / 9) + 10 * np.sin(at / 31))
    md = np.arange(n, dtype=float)
    z = -9000 - 0.05 * md
    truth = 10050 + 0.3 * md + 6 * np.sin(md / 40)
    gr = curve(truth) + rng.normal(0, 1, n)
    gr[rng.random(n) < 0.05] = np.nan
    return {"MD": md, "X": md * 0.9, "Y": md * 0.3, "Z": z, "GR": gr, "TVT_input": np.where(md < cut, truth, np.nan)}, curve, truth[cut:]


def test_filter_follows_the_hidden_level_and_seeds_stand_alone():
    frame, curve, truth = well()
    s = pf.FilterSettings(particles=300)
    t = pf.track(frame, curve, [0, 1, 2, 3, 4, 5, 6, 7], s)
    assert t.path.shape == t.evidence.shape == (8, 60)
    assert np.sqrt(np.mean((pf.by_likelihood(t) - truth) ** 2)) < 8
    assert np.allclose(pf.track(frame, curve, [5], s).path[0], t.path[5])
    assert not np.allclose(t.path[0], t.path[1])
    poisoned = dict(frame, TVT=np.full(160, 1e6))
    assert np.array_equal(pf.track(poisoned, curve, [5], s).path[0], t.path[5])
    chord = pf.track(frame, curve, [0, 1], pf.FilterSettings(particles=300, chord=True))
    assert np.isfinite(chord.path).all() and not np.allclose(chord.path, t.path[:2])


@pytest.mark.parametrize("kind", pf.RATE_KINDS)
def test_start_rate_of_a_line(kind):
    md = np.arange(140.0)
    assert pf.start_rate(md, 1100 + md, 50, kind) == pytest.approx(1.0)
    assert pf.start_rate(md, 1100 + md, 50, kind, 0.5) == pytest.approx(0.5)
    assert pf.start_rate(md[:2], md[:2], 50, kind) == 0


def test_effective_size_is_reached_and_no_further():
    w = pf.softmax(np.array([0.0, -1, -4, -9, -9, -9, -9, -9]))
    for least in (2.0, 4.0, 6.0, 8.0):
        m = pf.with_effective_size(w, least)
        assert m.sum() == pytest.approx(1) and 1 / (m @ m) == pytest.approx(max(least, 1 / (w @ w)))
    assert np.allclose(pf.with_effective_size(w, 1.0), w)
    with pytest.raises(ValueError):
        pf.with_effective_size(w, 9)


def test_candidates_are_forty_and_see_no_later_evidence():
    rng = np.random.default_rng(1)
    t = pf.Track(rng.normal(size=(8, 30)), rng.normal(size=(8, 30)))
    made = pf.candidates(t)
    assert len(made) == 40
    later = pf.Track(t.path, t.evidence.copy())
    later.evidence[:, 20:] = 50
    again = pf.candidates(later)
    assert np.allclose(made["pbma_t8"][:21], again["pbma_t8"][:21]) and not np.allclose(made["lik_t8"], again["lik_t8"])
    assert np.allclose(made["trim1"], np.sort(t.path, 0)[1:-1].mean(0))


def dense(g):
    """Posterior means from the full transition matrix of a small grid."""
    s, v, n = len(g.slopes), len(g.values), len(g.rows)
    unit = np.eye(s * v).reshape(-1, s, v)
    f = np.full(s * v, 1.0) * np.tile(g.emission(0), s)
    f /= f.sum()
    forward, steps = [f], []
    for t in range(1, n):
        *places, k, mix = g._step(t, 1)
        m = np.stack([(mix @ g._blur(g._move(u, *places), k)).ravel() for u in unit])
        steps.append(m)
        f = f @ m * np.tile(g.emission(t), s)
        f /= f.sum()
        forward.append(f)
    return forward, steps


def test_grid_forward_is_the_dense_chain_and_segments_do_not_matter():
    frame, curve, truth = well(70, 50)
    curve = pf.Curve(curve.at[200:340], curve.value[200:340])
    c = dict(step=4.0, margin=8.0, slopes=5, stride=5)
    a = GridSmoother(frame, curve, GridSettings(**c, segment=3))
    forward, _ = dense(a)
    m = a._normal(np.full((5, len(a.values)), 1.0) * a.emission(0))[0]
    for t in range(1, len(a.rows)):
        m = a.ahead(m, t)[0]
        assert np.allclose(m.ravel(), forward[t])
    x, y = a.run(), GridSmoother(frame, curve, GridSettings(**c, segment=1000)).run()
    assert np.allclose(x[0], y[0]) and np.allclose(x[1], y[1]) and x[2] == pytest.approx(y[2])


def test_grid_follows_the_hidden_level():
    frame, curve, truth = well()
    mean, std, logl = GridSmoother(frame, curve, GridSettings(step=1.0)).run()
    assert np.sqrt(np.mean((mean - truth) ** 2)) < 8 and (std > 0).all() and np.isfinite(logl)


def test_grid_looks_at_every_row():
    """Any row's signal counts, however far before the hidden part, and every hidden row is smoothed itself."""
    frame, curve, _ = well(720, 690)
    s = GridSettings(step=8.0, slopes=3)
    g = GridSmoother(frame, curve, s)
    likely = g.run()[2]
    assert len(g.rows) == 720
    for row in (*range(0, 80, 7), *range(690, 720)):
        other = dict(frame, GR=frame["GR"].copy())
        other["GR"][row] = 400.0 if np.isnan(frame["GR"][row]) else np.nan
        assert GridSmoother(other, curve, s).run()[2] != likely, row
    early = dict(frame, GR=frame["GR"] + np.where(np.arange(720) < 600, 30.0, 0.0))
    assert GridSmoother(early, curve, s).offset == pytest.approx(g.offset + 30, abs=2)


def plain_grid(g):
    """Means and deviations of hidden rows, by loops over the whole grid."""
    n, v, k = len(g.rows), len(g.values), len(g.slopes)

    def moved(m, t, sign):
        out = np.zeros((k, v))
        for i, slope in enumerate(g.slopes):
            by = sign * (slope * g.d_md[t - 1] - g.d_z[t - 1]) / g.c.step
            for j in range(v):
                for at, share in ((j + int(np.floor(by)), 1 - by % 1), (j + int(np.floor(by)) + 1, by % 1)):
                    if 0 <= at < v:
                        out[i, at] += share * m[i, j]
        return out

    f = [np.ones((k, v)) * g.emission(0)]
    for t in range(1, n):
        *_, blur, mix = g._step(t, 1)
        m = mix @ g._blur(moved(f[-1] / f[-1].sum(), t, 1), blur) * g.emission(t)
        f.append(m)
    b, out = np.ones((k, v)), {}
    for t in range(n - 1, -1, -1):
        p = (f[t] / f[t].sum() * b).sum(0)
        p /= p.sum()
        out[g.rows[t]] = p @ g.values, np.sqrt(p @ (g.values - p @ g.values) ** 2)
        if t:
            *_, blur, mix = g._step(t, -1)
            b = moved(g._blur(mix @ (b * g.emission(t)), blur), t, -1)
            b /= b.sum()
    return np.array([out[r] for r in g.hidden]).T


@pytest.mark.parametrize("segment", [1, 4, 1000])
def test_grid_held_by_bands_is_the_whole_grid(segment):
    frame, curve, _ = well(44, 25)
    frame["MD"] = np.cumsum(np.r_[np.ones(20), np.full(24, 7.0)])
    frame["MD"][30] = frame["MD"][29]
    g = GridSmoother(frame, pf.Curve(curve.at[200:340], curve.value[200:340]), GridSettings(step=2.0, margin=8.0, slopes=5, segment=segment))
    mean, std, _ = g.run()
    want = plain_grid(g)
    assert np.allclose(mean, want[0]) and np.allclose(std, want[1], atol=1e-5)


def test_projection_is_the_nearest_point():
    assert np.allclose(st.nearest_within(np.array([10.0, 1.0]), np.sqrt(26 / 2), 5.0), [5.0, 1.0])
    assert np.allclose(st.radial(np.array([10.0, 1.0]), np.sqrt(26 / 2), 5.0)[0], [5.0, 0.5])
    rng = np.random.default_rng(3)
    for _ in range(60):
        move, cap, row = rng.normal(0, 4, 12), rng.uniform(0.3, 3), rng.uniform(0.5, 6)
        p = st.nearest_within(move, cap, row)
        assert st.rms(p) <= cap * (1 + 1e-9) and np.abs(p).max() <= row * (1 + 1e-9)
        for _ in range(200):
            q = p + rng.normal(0, 0.3, 12)
            q = np.clip(q, -row, row)
            q *= min(1, cap / max(st.rms(q), 1e-12))
            assert np.linalg.norm(move - p) <= np.linalg.norm(move - q) + 1e-9
    assert np.allclose(st.nearest_within(np.ones(3), 0.0, 1.0), 0)


def test_simplex_weights_beat_clipping():
    cov = np.array([[1, 0.9, 0.1], [0.9, 1, 0.8], [0.1, 0.8, 1]])
    w = st.simplex_weights(cov)
    raw = np.maximum(np.linalg.solve(cov, np.ones(3)), 0)
    raw /= raw.sum()
    assert w.min() >= 0 and w.sum() == pytest.approx(1) and w @ cov @ w <= raw @ cov @ raw + 1e-12
    for x in np.random.default_rng(0).dirichlet(np.ones(3), 500):
        assert w @ cov @ w <= x @ cov @ x + 1e-12


def test_smoother_is_the_joint_least_squares():
    rng = np.random.default_rng(5)
    h = np.arange(0, 200, 20.0)
    y = np.sin(h / 60) + rng.normal(0, 0.1, len(h))
    got = st.smooth(h, y, 0.01, 0.05, 1)
    n, u = len(h), h / 100
    k = u[:8] - u[0]
    x0 = np.linalg.lstsq(np.stack([np.ones(8), k, k * k / 2], 1), y[:8], rcond=None)[0]
    info, right = np.zeros((3 * n, 3 * n)), np.zeros(3 * n)
    p0 = np.linalg.inv(0.01 * np.diag([1.0, 4, 16]))
    info[:3, :3] += p0
    right[:3] += p0 @ x0
    for t in range(n):
        info[3 * t, 3 * t] += 100
        right[3 * t] += 100 * y[t]
        if t:
            f, q = st.motion(u[t] - u[t - 1], 0.05)
            a = np.zeros((3, 3 * n))
            a[:, 3 * t - 3 : 3 * t], a[:, 3 * t : 3 * t + 3] = -f, np.eye(3)
            info += a.T @ np.linalg.inv(q) @ a
    assert np.allclose(got, np.linalg.solve(info, right)[::3], atol=1e-6)


def experts(n=150):
    h = np.arange(1.0, n + 1)
    base = np.zeros(n)
    return base, h


def test_switching_raises_the_fault_regime_on_a_step():
    base, h = experts()
    e = np.zeros((150, 3))
    e[70:] = 8.0
    made, state, p, d = st.switching(base, e, h, 2.0)
    assert np.allclose(p.sum(1), 1) and d["peak_fault_up"] > 3 * d["peak_fault_down"] and made[-1] > 2
    assert st.rms(made) <= 5 + 1e-9 and np.abs(made).max() <= 10 + 1e-9
    _, _, q, _ = st.switching(base, -e, h, 2.0)
    assert np.allclose(p[:, 1], q[:, 2], atol=1e-9)
    apart = np.zeros((150, 3))
    apart[45:90] = [25.0, -25.0, 0.0]
    assert st.switching(base, apart, h, 2.0)[2][50:85, 3].mean() > p[:40, 3].mean()
    with pytest.raises(ValueError):
        st.switching(base, e, h[::-1], 2.0)
    with pytest.raises(ValueError):
        st.SwitchSettings(initial=(1.0, 1.0, 0.0, 0.0)).check()


def test_fusion_keeps_its_caps():
    base, h = experts()
    rng = np.random.default_rng(1)
    e = rng.normal(0, 30, (150, 3))
    for exact in (False, True):
        made, _, d = st.fuse(base, e, h, 3.0, st.FusionSettings(exact=exact))
        assert st.rms(made) <= 5 + 1e-9 and np.abs(made).max() <= 10 + 1e-9 and 0.25 <= d["reliability"] <= 1


def test_stack_weights_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a = rng.normal(size=(40, 4))
        y = a @ rng.normal(size=4) + rng.normal(size=40)
        g, c = a.T @ a / 40, a.T @ y / 40
        w = b.solve_capped_simplex(g, c, 0.01)
        value = lambda x: x @ g @ x - 2 * c @ x + 0.01 * x @ x
        assert w.min() >= 0 and w.sum() <= 1 + 1e-9
        for x in rng.dirichlet(np.ones(5), 400)[:, :4]:
            assert value(w) <= value(x) + 1e-9


def test_folds_balance():
    sizes = {f"g{i}": n for i, n in enumerate([9, 7, 6, 5, 5, 4, 2, 1])}
    fold = b.balanced(sizes, 3)
    load = [sum(n for g, n in sizes.items() if fold[g] == k) for k in range(3)]
    assert max(load) - min(load) <= 2
    with pytest.raises(ValueError):
        b.balanced({"a": 1}, 2)


def test_ridge_is_the_normal_equation():
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(50, 3)) * [1, 5, 0.1], rng.uniform(0.5, 2, 50)
    y = x @ [1.0, -2, 3] + rng.normal(size=50)
    m = b.Ridge.fit(x, y, w, 10.0)
    z = (x - m.mean) / m.scale
    grad = (z * w[:, None]).T @ (z @ m.coef + m.intercept - y) + 10 * m.coef
    assert np.allclose(grad, 0, atol=1e-8) and w @ (z @ m.coef + m.intercept - y) == pytest.approx(0, abs=1e-8)


def test_beam_is_the_best_path_when_wide():
    from cairn.functions import matching as m

    rng = np.random.default_rng(0)
    signal, ref = rng.normal(size=12), rng.normal(size=9)
    got = m.beam(signal, ref, 4, 1000, 0.3, 1.0)
    cost = np.full(9, np.inf)
    cost[4] = 0
    for g in signal:  # all knots at once
        cost = np.array([min(cost[j] + 0.3 * abs(i - j) for j in range(max(0, i - 2), min(9, i + 3))) for i in range(9)]) + (g - ref) ** 2
    path = np.concatenate([[4], got])
    assert (np.abs(np.diff(path)) <= 2).all()
    assert ((signal - ref[got]) ** 2).sum() + 0.3 * np.abs(np.diff(path)).sum() == pytest.approx(cost.min())
    assert len(m.beam(signal, ref, 4, 1, 0.3, 1.0)) == 12


def test_window_match_finds_a_copied_window():
    from cairn.functions import matching as m

    rng = np.random.default_rng(1)
    known = rng.normal(size=150).cumsum()
    level, score = m.window_match(known, np.arange(150.0), known[60:111], 8, stride=1)
    assert np.allclose(level[12:-12], np.arange(60, 111)[12:-12]) and score[12:-12].min() > 0.999
    short = m.window_match(known[:10], np.arange(10.0), known[60:65], 8)
    assert (short[0] == 9).all() and (short[1] == 0).all()


def test_series_seeds_and_nearest_knots():
    import hashlib

    from cairn.functions import matching as m

    assert m.series_seed(42, "a") == int.from_bytes(hashlib.sha256(b"42:a").digest()[:4], "little") != m.series_seed(42, "b")
    with pytest.raises(ValueError):
        m.series_seed(2**32, "a")
    at = np.array([0.0, 1.0, 4.0])
    assert [m.nearest_knot(at, x) for x in (-5, 0.5, 0.51, 2.5, 2.6, 9)] == [0, 0, 1, 1, 2, 2]


def test_velocity_filter_follows_elevation():
    from cairn.functions import matching as m

    frame, curve, truth = well()
    mean, std = m.velocity_track(frame, curve.at, curve.value, 15.0, 3)
    assert np.sqrt(np.mean((mean - truth) ** 2)) < 15 and np.isfinite(std).all()
