"""PartEnum signatures for a Jaccard threshold of ``num / den``.

Sizes are cut into bands. A pair belongs to the band of its smaller set; there
its symmetric difference is at most ``k`` features (``(a+b) * (den-num) /
(den+num)``). The feature domain is hashed into ``n1`` first-level groups of
``n2`` parts each. With ``n1 * (k2 + 1) > k`` some group holds at most ``k2``
differences, so some choice of ``n2 - k2`` of its parts agrees, and each such
choice of each group is one signature. A choice that is empty in both sets says
nothing and is not emitted; a set that has so many empty choices that nothing
but these might agree emits the tokens of a prefix filter besides. Both sets of
such a pair are in that state, hence no pair is lost. If one set alone is in it,
the two share a choice that isn't empty.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from tallyline.llm.vectext import U, mix

RATIO = 1.7
PREFIX_BAND = 254


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    reach: int  # largest partner
    k: int
    n1: int


@lru_cache
def bands(num: int, den: int, k2: int, slack: float, upto: int) -> tuple[Band, ...]:
    out, low = [], 1
    while low <= upto:
        high = max(low, int(low * RATIO))
        reach = high * den // num
        k = (high + reach) * (den - num) // (den + num)
        least = k // (k2 + 1) + 1
        out.append(Band(low, high, reach, k, least + int(np.ceil(slack * least))))
        low = high + 1
    return tuple(out)


def signatures(hashes: np.ndarray, doc: np.ndarray, sizes: np.ndarray, num: int = 4, den: int = 5, k2: int = 0, n2: int = 1, slack: float = 0.15, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, row, band, room) for sets given as hashes sorted by row.

    A set shares at least ``room`` of its signatures of a band with any partner
    of that band, unless both have so many empty choices that they meet by a
    prefix token alone. Bands count from 0; the prefix filter's tokens are band 254.
    """
    if not len(hashes):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    found = bands(num, den, k2, slack, int(sizes.max()))
    low = np.array([b.low for b in found])
    own = np.searchsorted(low, sizes, "right") - 1
    out_sig, out_doc, out_band, rooms, scarce = [], [], [], [], np.zeros(len(sizes), bool)
    for step in (0, 1):
        band = own - step
        high = np.array([b.high for b in found])[np.maximum(band, 0)]
        takes = (sizes > 0) & (band >= 0) & (high * den >= sizes * num) if step else sizes > 0
        if not takes.any():
            continue
        n1 = np.where(takes, np.array([b.n1 for b in found])[np.maximum(band, 0)], 0)
        k = np.array([b.k for b in found])[np.maximum(band, 0)]
        use = takes[doc]
        h, d = hashes[use], doc[use]
        salt = mix((band.astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15) + U(seed))
        x = mix(h + salt[d])
        parts = n1 * n2
        base = np.cumsum(parts) - parts
        cell = base[d] + ((x >> U(32)) * parts[d].astype(np.uint64) >> U(32)).astype(np.int64)
        total = np.zeros(int(parts.sum()), np.uint64)
        np.add.at(total, cell, mix(x ^ U(0x5851F42D4C957F2D)))
        filled = np.bincount(cell, minlength=len(total)) > 0
        of = np.repeat(np.arange(len(sizes)), parts)
        at = np.arange(len(total)) - base[of]
        if n2 == 1:
            keep = filled
            out_sig.append(mix(total[keep] + salt[of[keep]] + at[keep].astype(np.uint64) * U(0xD1342543DE82EF95)))
            out_doc.append(of[keep])
            empty = np.bincount(of[~filled], minlength=len(sizes))
        else:  # leave one part of each group out: n2 choices of n2 - 1 parts
            group = total.reshape(-1, n2)
            some = filled.reshape(-1, n2)
            gof, gat = of[::n2], at[::n2] // n2
            empty = np.zeros(len(sizes), np.int64)
            marked = mix(group + (np.arange(n2, dtype=np.uint64) + U(7)) * U(0xA0761D6478BD642F)) * some
            whole, has = marked.sum(1, dtype=np.uint64), some.sum(1)
            none = np.zeros(len(gof), bool)
            for left in range(n2):
                keep = has - some[:, left] > 0
                none |= ~keep
                tag = gat[keep].astype(np.uint64) * U(n2) + U(left)
                out_sig.append(mix(whole[keep] - marked[keep, left] + salt[gof[keep]] + tag * U(0xD1342543DE82EF95)))
                out_doc.append(gof[keep])
            # a difference spoils one part: choices of one part are counted by part, others by group
            empty = np.bincount(of[~filled], minlength=len(sizes)) if n2 == 2 else np.bincount(gof[none], minlength=len(sizes))
        agree = parts - k if n2 == k2 + 1 else n1 - k // (k2 + 1)
        scarce |= takes & (empty >= agree)
        new = np.concatenate(out_doc)[sum(map(len, out_band)) :]
        out_band.append(band[new])
        rooms.append(np.maximum(agree - empty, 1)[new])
    sig, row, of_band, room = (np.concatenate(x) for x in (out_sig, out_doc, out_band, rooms))
    if scarce.any():
        use = scarce[doc]
        h, d = mix(hashes[use] ^ U(0x2545F4914F6CDD1D)), doc[use]
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        size = np.where(scarce, sizes, 0)
        rank = np.arange(len(h)) - (np.cumsum(size) - size)[d]
        keep = rank < (sizes - (sizes * num + den - 1) // den + 1)[d]
        sig, row = np.concatenate([sig, mix(h[keep] + U(0x853C49E6748FEA9B))]), np.concatenate([row, d[keep]])
        of_band = np.concatenate([of_band, np.full(keep.sum(), PREFIX_BAND)])
        room = np.concatenate([room, np.ones(keep.sum(), np.int64)])
    return sig, row, of_band, np.minimum(room, 65535)
