"""Which pairs of a block of left and a block of right listings can be the best of their left one, if all are different products.

Scores rise with those of the texts. All pairs of a block get a bound in columns, as in matching.bounds but with the true cosine; strings
are only compared where a bound reaches the best score found so far.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd

from tidemark.config import MatchingConfig
from tidemark.functions.similarity import OVERLAP_WEIGHT, RATIO_WEIGHT, fuzzy_overlap, gram_vector, title_score

#: More than what rounding the parts of a score can change in it.
SLACK = 4e-4


def _numbered(values: Iterable) -> list[tuple]:
    seen, out = {}, []
    for x in values:
        seen[x] = seen.get(x, 0) + 1
        out.append((x, seen[x]))
    return out


def _common(left: list, right: list) -> np.ndarray:
    """How many values each two lists of distinct values have in common."""
    places = {x: i for i, x in enumerate(sorted({x for row in left for x in row} & {x for row in right for x in row}))}
    out = [np.zeros((len(rows), len(places)), np.float32) for rows in (left, right)]
    for rows, bits in zip((left, right), out):
        for i, row in enumerate(rows):
            bits[i, [places[x] for x in row if x in places]] = 1
    return out[0] @ out[1].T


def _held(left: list, right: list, alike: list) -> tuple[np.ndarray, np.ndarray]:
    """Whether both sides have a value, and whether the right one is among those alike the left one."""
    names, code = np.unique(np.array([x or "" for x in right], object), return_inverse=True)
    rows, told = [], {}
    for x, those in zip(left, alike):
        if x not in told:
            told[x] = np.isin(names, np.array([] if those is None else list(those), object))
        rows.append(told[x])
    both = np.array([bool(x) for x in left])[:, None] & np.array([bool(x) for x in right])[None]
    return both, np.array(rows)[:, code]


def _variants(left: list, right: list, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Whether both sides have a variant attribute, and whether they agree in it, as in matching.alike_values."""
    def agree(a: str | None, b: str | None) -> bool:
        return a is not None and b is not None and (a == b or key == "color" and (bool(set(a.split(" ")) & set(b.split(" "))) or a in b or b in a))

    codes = [pd.factorize(np.array(x, object), use_na_sentinel=True) for x in (left, right)]
    (a, of), (b, others) = codes
    both = (a >= 0)[:, None] & (b >= 0)[None]
    if not len(of) or not len(others):
        return both, both
    if key == "color":
        same = np.array([[agree(x, y) for y in others] for x in of])[a][:, b]
    else:
        place = {x: i for i, x in enumerate(others)}
        same = np.array([place.get(x, -1) for x in of])[a][:, None] == b[None]
    return both, both & same


def _parts(left: pd.DataFrame, right: pd.DataFrame, keys: list[str], c: MatchingConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rest, weight, most) of all pairs: a score is the rest and weight times the title's score, and at most `most`. It follows matching.decide."""
    shape = len(left), len(right)
    conflict, matched = np.zeros(shape, bool), np.zeros(shape, bool)
    families = {x.split(":", 1)[0] for ids in (*left["ids"], *right["ids"]) for x in ids}
    for f in families:
        mine = [[[x for x in ids if x.split(":", 1)[0] == f] for ids in side["ids"]] for side in (left, right)]
        shared = _common(*mine) > 0
        matched |= shared
        conflict |= np.array([bool(x) for x in mine[0]])[:, None] & np.array([bool(x) for x in mine[1]])[None] & ~shared
    torn, both_have, agreeing = np.zeros(shape, bool), np.zeros(shape, np.float32), np.zeros(shape, np.float32)
    for i, k in enumerate(keys):
        both, same = _variants([x[i] for x in left["variants"]], [x[i] for x in right["variants"]], k)
        torn |= both & ~same
        both_have += both
        agreeing += same
    accessory = left["accessory"].to_numpy(bool)[:, None] != right["accessory"].to_numpy(bool)[None]
    half, no = {}, {}
    for x in ("brand_sig", "hint"):
        both, alike = _held(list(left[x]), list(right[x]), list(left[f"alike_{x}"]))
        half[x], no[x] = np.where(both, np.where(alike, 1.0, 0.0), 0.5), both & ~alike
    share = np.divide(agreeing, both_have, out=np.zeros(shape, np.float32), where=both_have > 0)
    plain = np.minimum(1.0, 0.35 * half["brand_sig"] + 0.35 * half["hint"] + 0.30 * share)
    attributes = np.select([accessory | torn, no["hint"], no["brand_sig"]], [0.0, 0.05, 0.1], plain)
    vectors = [np.array([gram_vector(x, c.dimension) for x in side["document"]], np.float64) for side in (left, right)]
    size = [np.sqrt((x * x).sum(axis=1)) for x in vectors]
    unit = [np.divide(x, n[:, None], out=np.zeros_like(x), where=n[:, None] > 0) for x, n in zip(vectors, size)]
    cosine = np.clip(unit[0] @ unit[1].T, 0.0, 1.0)
    told = conflict | matched
    whole = np.where(told, c.weight_identifier, 0.0) + c.weight_attributes + c.weight_title + c.weight_embedding
    rest = (np.where(matched & ~conflict, c.weight_identifier, 0.0) + attributes * c.weight_attributes + cosine * c.weight_embedding) / whole
    most = np.select([conflict, accessory, torn, no["hint"] & ~matched, no["brand_sig"] & ~matched], [0.2, 0.25, 0.45, 0.4, 0.35], 1.0)
    return rest, c.weight_title / whole, most


def _title_bounds(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """No title score of a pair is above this; see similarity.title_bound. A word counts as met if it is, or is alike, one of the left side's."""
    numbered = [[_numbered(x) for x in side["tokens"]] for side in (left, right)]
    forms = {}
    for row in numbered[1]:
        for x in row:
            forms.setdefault(x[0], set()).add(x)
    reached = [set(own).union(*(forms.get(x, ()) for x in ([] if near is None else near))) for own, near in zip(numbered[0], left["near"])]
    sizes = [np.array([len(x) for x in rows], np.float32) for rows in numbered]
    n = sizes[0][:, None] + sizes[1][None]
    hits = np.minimum(_common(reached, numbered[1]), np.minimum(sizes[0][:, None], sizes[1][None]))
    overlap = np.divide(hits, n - hits, out=np.ones_like(n), where=n > hits)
    chars = [[_numbered(" ".join(sorted(x))) for x in side["tokens"]] for side in (left, right)]
    lengths = [np.array([len(x) for x in rows], np.float32) for rows in chars]
    m = lengths[0][:, None] + lengths[1][None]
    bag = np.divide(2 * _common(*chars), m, out=np.ones_like(m), where=m > 0)
    return np.minimum(1.0, OVERLAP_WEIGHT * overlap + RATIO_WEIGHT * bag + 1e-4)


def hopeful(left: pd.DataFrame, right: pd.DataFrame, keys: list[str], c: MatchingConfig) -> pd.DataFrame:
    """(left_id, right_id) of the pairs with a blocking key in common whose score is, but for rounding, the best of their left one in this block."""
    if not len(left) or not len(right):
        return pd.DataFrame({"left_id": pd.Series([], dtype=object), "right_id": pd.Series([], dtype=object)})
    rest, weight, most = _parts(left, right, keys, c)
    bound = np.where(_common(list(left["keys"]), list(right["keys"])) > 0, np.minimum(rest + weight * _title_bounds(left, right), most), -1.0)
    tokens = [[list(x) for x in side["tokens"]] for side in (left, right)]
    found = []
    for i in range(len(left)):
        row, titles, scores, best = bound[i], {}, [], -1.0
        at = np.flatnonzero(row >= 0)
        for j in at[np.argsort(-row[at], kind="stable")]:
            if row[j] < best - SLACK:
                break
            title = tuple(tokens[1][j])
            if title not in titles:
                titles[title] = title_score(fuzzy_overlap(tokens[0][i], tokens[1][j], c.token_ratio), " ".join(sorted(tokens[0][i])), " ".join(sorted(title)))
            scores.append((j, min(rest[i, j] + weight[i, j] * titles[title], most[i, j])))
            best = max(best, scores[-1][1])
        found.extend((i, j) for j, score in scores if score >= best - SLACK)
    ids = left["cid"].to_numpy(), right["cid"].to_numpy()
    return pd.DataFrame({"left_id": [ids[0][i] for i, _ in found], "right_id": [ids[1][j] for _, j in found]}, dtype=object)
