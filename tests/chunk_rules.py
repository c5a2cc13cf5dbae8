"""Grouping and packing of one document with numpy: what the columns of chunking.py are held against."""

from __future__ import annotations

import numpy as np


def group_by_meaning(vectors: np.ndarray) -> list[int]:
    """The group number of each sentence. Up to three sentences are one group. A sentence opens a group where its
    cosine to the open group's sum is under the threshold and that group has two members at least.
    """
    vectors = np.asarray(vectors, float)
    if len(vectors) <= 3:
        return [0] * len(vectors)
    length = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(length > 0, length, 1)[:, None]
    near = np.einsum("ij,ij->i", unit[1:], unit[:-1])
    spread = near.std()
    threshold = 0.4 if spread == 0 else max(0.35, near.mean() - 0.15 * spread)
    sums = np.concatenate([np.zeros((1, vectors.shape[1])), np.cumsum(vectors, axis=0)])
    begins = [0]
    for i in range(2, len(vectors)):
        if i - begins[-1] < 2:
            continue
        open_sum = sums[i] - sums[begins[-1]]
        scale = np.linalg.norm(open_sum)
        if (float(open_sum @ unit[i] / scale) if scale > 0 else 0.0) < threshold:
            begins.append(i)
    return (np.searchsorted(begins, np.arange(len(vectors)), "right") - 1).tolist()


def _fits(prefix: np.ndarray, begin: int, end: int, room: int) -> int:
    """The furthest place up to end that a run from begin can reach within room words."""
    return min(end, int(np.searchsorted(prefix, prefix[begin] + room, "right")) - 1)


def cut_places(counts: list[int], groups: list[int], max_tokens: int, overlap: int) -> list[tuple[list[tuple[int, int]], bool]]:
    """Where chunks lie, before any text is joined: for each its spans of sentences, and whether it closes the text.

    counts: words of each sentence. groups: how many sentences each group has. A group over max_tokens is cut
    at once, whatever is open: each cut is as long as it fits behind the overlap of the cut before, and has one
    sentence at least. Other groups join the open chunk until one does not fit; the next chunk begins with the
    overlap. So a chunk is a list of spans: what stays open around an oversized group lies on both its sides.
    """
    prefix = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    ends = np.cumsum(groups).tolist()
    out: list[tuple[list[tuple[int, int]], bool]] = []
    spans: list[tuple[int, int]] = []

    def words(of: list[tuple[int, int]]) -> int:
        return int(sum(prefix[b] - prefix[a] for a, b in of))

    def last_of(of: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The spans of the last sentences, as many as overlap."""
        kept, need = [], max(0, overlap)
        for a, b in reversed(of):
            if need > 0:
                kept.append((max(a, b - need), b))
                need -= b - kept[-1][0]
        return kept[::-1]

    for number, end in enumerate(ends):
        begin = end - groups[number]
        if words([(begin, end)]) > max_tokens:
            head = begin  # the overlap, if any, lies from head to at
            at = begin
            while at < end:
                to = max(at + 1, _fits(prefix, head, end, max_tokens))
                out.append(([(head, to)], number + 1 == len(ends) and to == end))
                head, at = max(head, to - max(0, overlap)), to
            continue
        if words(spans) + words([(begin, end)]) > max_tokens:
            if spans:
                out.append((spans, False))
            spans = last_of(spans)
        if begin < end:
            spans = [*spans, (begin, end)]
    if spans:
        out.append((spans, True))
    return out


def pack(groups: list[list[str]], max_tokens: int, overlap: int) -> list[tuple[str, int]]:
    """(text, tokens) of the chunks that cut_places() finds; one that does not close the text ends with a stop."""
    sentences = [s for g in groups for s in g]
    out = []
    for spans, closes in cut_places([len(s.split()) for s in sentences], list(map(len, groups)), max_tokens, overlap):
        text = " ".join(s for a, b in spans for s in sentences[a:b]).strip()
        if text and not closes and text[-1] not in ".!?":
            text += "."
        out.append((text, len(text.split())))
    return out
