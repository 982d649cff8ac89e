"""Board scales against least squares in numpy, on turned and skewed grids with gaps."""

import numpy as np
import pytest

from specloom.operators import corners as C


def test_turned_and_skewed_boards(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for b, (turn, shear) in enumerate([(0.0, 0.0), (0.3, 0.0), (1.4, 0.0), (2.9, 0.0), (0.2, 0.25), (-1.2, 0.0)]):
        a = np.radians(np.degrees(turn))
        physical = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]) @ np.array([[1.0, shear], [0.0, 1.0]])
        # the longer side of a cell is whichever lies along the scan
        side = [2.0, 3.0] if abs(np.cos(a)) >= abs(np.sin(a)) else [3.0, 2.0]
        A = np.diag([8.0, 17.0]) @ physical @ np.diag(side)
        for n in range(48):
            if rng.random() < 0.8:
                x, y = A @ [n % 8, n // 8] + [500, 300] + rng.normal(0, 0.05, 2)
                rows.append((b, n, float(x), float(y)))
        G = np.diag([8.0, 17.0]) @ physical @ physical.T @ np.diag([8.0, 17.0])
        want[b] = (G[0, 0] ** 0.5, G[1, 1] ** 0.5, np.degrees(np.arcsin(G[0, 1] / (G[0, 0] * G[1, 1]) ** 0.5)))
    rows += [(90, 0, 1.0, 1.0), (90, 1, 2.0, 1.0), (91, 3, 0.0, 0.0), (92, None, 1.0, 2.0), (92, 4, None, 2.0)]
    got = {r["b"]: r for r in C.board_scales(spark.createDataFrame(rows, "b int, n int, x double, y double"), ["b"], 8, (2.0, 3.0)).collect()}
    for b, (scan, spatial, skew) in want.items():
        r = got[b]
        assert abs(r["px_scan"] / scan - 1) < 0.01 and abs(r["px_spatial"] / spatial - 1) < 0.01 and abs(r["skew_deg"] - skew) < 0.5
        assert r["rms_px"] < 0.2 and abs(r["theta_deg"]) < 90
    assert abs(got[4]["skew_deg"]) > 5
    # a line or a point spans nothing; a board without any placed corner has no row
    assert got[90]["px_scan"] is None and got[91]["px_scan"] is None and 92 not in got
    with pytest.raises(ValueError):
        C.board_scales(spark.createDataFrame(rows, "b int, n int, x double, y double"), ["b"], 8, (0.0, 1.0))
