"""The calibration on labels that an undamped solver fails on; long lists and deep pages in wrapper inference."""

import numpy as np
import pytest

from causeway.llm import html, quality


def slope(x, y, weight, w, ridge=0.1):
    return x.T @ (weight * (1 / (1 + np.exp(-np.clip(x @ w, -700, 700))) - y)) + ridge * w


def test_calibration_ends_at_the_least_loss():
    rng = np.random.default_rng(2)
    y = (np.arange(3000) % 7 > 0).astype(float)
    d = np.where(y == 1, 0.05, -0.2) + rng.normal(0, 0.02, 3000) * np.where(y == 1, 1, 4)
    c = rng.normal(0, 1, 3000)
    for columns in ([d], [d, d * d], [d, d * d, c], [d, d * d, d**3, d**4], [np.where(y == 1, 1.0, -1.0)], [1000 * d], [np.zeros(3000)]):
        x = np.stack(columns, axis=1)
        x = np.column_stack([np.ones(len(x)), (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9)])
        for weight in (np.ones(3000), np.where(y == 1, 0.2, 9.0)):
            w = quality.calibrated(x, y, weight)
            assert np.isfinite(w).all() and np.abs(slope(x, y, weight, w)).max() < 1e-2 * weight.sum() ** 0.5, (len(columns), w)
            right = ((x @ w > 0) == (y == 1)).mean()
            assert right > 0.97 or not d.std() or columns[0] is not d


def test_separable_labels():
    x = np.column_stack([np.ones(40), np.repeat([-1.0, 1.0], 20)])
    y = np.repeat([0.0, 1.0], 20)
    w = quality.calibrated(x, y, np.ones(40))
    assert np.isfinite(w).all() and ((x @ w > 0) == (y == 1)).all()


def table_common(a, b):
    """By the whole table, cell by cell."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    found, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif t[i + 1][j] >= t[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


def test_longest_common_part():
    rng = np.random.default_rng(7)
    for _ in range(400):
        a, b = (list(map(str, rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(0, 30))))) for _ in range(2))
        assert html._common(a, b) == table_common(a, b)


def test_long_lists():
    """5,000 items with some of them gone are all found again."""
    a = [f"k{i}" for i in range(5000)]
    b = [x for i, x in enumerate(a) if i % 97] + ["end"]
    assert html._common(a, b) == [(i, j) for j, i in enumerate(i for i in range(5000) if i % 97)]


@pytest.mark.parametrize("depth", [10, 100, 149, 150, 160, 500, 3000])
def test_deep_pages(depth):
    """Menus, comments and forms are left out however deep they stand."""
    inner = "<p>the main text</p><nav><ul><li>menu one</li></ul></nav><div class='comments'><div><p>a comment</p></div></div><form><p>your name</p></form><p>its end</p>"
    page = "<html><body><article>" + "<div>" * depth + inner + "</div>" * depth + "<p>after it</p></article></body></html>"
    root = html.parsed(page)
    assert [t for t, _ in root.texts()] == ["the main text", "its end", "after it"]
