"""Decoding of per-token BIOES tag probabilities into spans: legal transitions, Viterbi, merging."""

from __future__ import annotations

import numpy as np


def split_tag(tag: str) -> tuple[str, str]:
    prefix, _, kind = tag.partition("-")
    return prefix, kind


def transitions(tags: list[str]) -> np.ndarray:
    """Which tag (row) may come before which (column): I and E go on with an open entity of their kind, others follow a closed one."""
    allowed = np.zeros((len(tags), len(tags)), bool)
    for i, before in enumerate(tags):
        p, kind = split_tag(before)
        for j, tag in enumerate(tags):
            q, own = split_tag(tag)
            allowed[i, j] = p in ("B", "I") and kind == own if q in ("I", "E") else p in ("O", "E", "S")
    return allowed


def viterbi(log_probs: np.ndarray, tags: list[str]) -> list[int]:
    """The likeliest legal tag sequence; it starts with O, B or S and ends with O, E or S."""
    if not len(log_probs):
        return []
    allowed = np.where(transitions(tags), 0.0, -np.inf)
    heads = np.array([split_tag(t)[0] for t in tags])
    score = np.where(np.isin(heads, ["O", "B", "S"]), log_probs[0], -np.inf)
    back = np.zeros(log_probs.shape, int)
    for t in range(1, len(log_probs)):
        step = score[:, None] + allowed
        back[t] = step.argmax(0)
        score = step.max(0) + log_probs[t]
    score = np.where(np.isin(heads, ["O", "E", "S"]), score, -np.inf)
    path = [int(score.argmax())]
    for t in range(len(log_probs) - 1, 0, -1):
        path.append(int(back[t][path[-1]]))
    return path[::-1]


def merge_tags(path: list[int], tags: list[str], probs: np.ndarray, offsets: list[tuple[int, int]], text: str) -> list[tuple[int, int, str, float]]:
    """Spans (start, end, kind, least probability) with white space off their ends; tokens without characters are skipped."""
    out: list[list] = []
    open_kind = None
    for t, k in enumerate(path):
        start, end = offsets[t]
        if start == end:
            continue
        head, kind = split_tag(tags[k])
        if head == "O":
            open_kind = None
        elif head in ("B", "S") or open_kind != kind:
            out.append([start, end, kind, float(probs[t][k])])
            open_kind = kind if head in ("B", "I") else None
        else:
            out[-1][1], out[-1][3] = end, min(out[-1][3], float(probs[t][k]))
            if head == "E":
                open_kind = None
    spans = []
    for start, end, kind, p in out:
        piece = text[start:end]
        start, end = start + len(piece) - len(piece.lstrip()), end - (len(piece) - len(piece.rstrip()))
        if start < end:
            spans.append((start, end, kind, p))
    return spans


def decode(logits: np.ndarray, tags: list[str], offsets: list[tuple[int, int]], text: str) -> list[tuple[int, int, str, float]]:
    shifted = logits - logits.max(1, keepdims=True)
    log_probs = shifted - np.log(np.exp(shifted).sum(1, keepdims=True))
    return merge_tags(viterbi(log_probs, tags), tags, np.exp(log_probs), offsets, text)
