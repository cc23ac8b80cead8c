"""License scans: an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.llm.text import column, hash_spans, in_batches, lowered, raw, spans

#: Statements by which works name their license, and the label of each.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("reserved", "All rights reserved"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Phrases that name a license by themselves.
PHRASES: tuple[tuple[str, str], ...] = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Places of prefix words whose surroundings are looked at together, so that a batch full of them stays small.
LOOSE = 2  # times the words of a template that a line or paragraph may have
CHUNK = 1 << 14

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def scan_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, line and text of each word of a batch; the number of each text's first word and of its first line. A text's end ends a line."""
    data, at = raw(texts)
    data = lowered(data)
    begins, ends = spans(_WORD[data], at)
    breaks = np.concatenate([[0], np.cumsum(data == 0x0A, dtype=np.int64)])
    text = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(begins, at)))
    return hash_spans(data, begins, ends), breaks[begins] + text, text, np.searchsorted(begins, at), breaks[at[:-1]] + np.arange(len(at) - 1)


def _hashes(text: str) -> np.ndarray:
    return scan_words(pa.array([text]))[0]


@dataclass(frozen=True)
class Index:
    """Templates as ordered tokens, the tokens of all of them and those that start a search."""

    vocabulary: np.ndarray  # sorted hashes
    tokens: tuple[np.ndarray, ...]  # of each template: places in the vocabulary, rarest first
    rank: np.ndarray  # of each word of the vocabulary in the global order
    labels: tuple[str, ...]
    prefixes: Mapping[int, Sequence[tuple[int, int]]]  # word: templates with it in their prefix, and where
    need: tuple[int, ...]  # tokens that a block must share
    lengths: tuple[int, ...]  # words of each template, repeated ones too
    bits: tuple[np.ndarray, ...]  # of each template: a row of 64-bit masks per word of the vocabulary, and a last one of zeros for other words


def vocabulary(templates: Sequence[tuple[str, str]]) -> np.ndarray:
    return np.unique(np.concatenate([_hashes(text) for _, text in templates]))


def _places(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Where each hash stands in the sorted ``words``, or -1."""
    at = np.searchsorted(words, hashes)
    at[at == len(words)] = 0
    return np.where(words[at] == hashes, at, -1)


def frequencies(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """Blocks of the whole corpus that hold each word: partial counts per batch, then at most len(words) rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, line, *_ = scan_words(column(batch, "text"))
            place = _places(hashes, words)
            met = place >= 0
            pairs = np.unique(line[met] * len(words) + place[met])
            n = np.bincount(pairs % len(words), minlength=len(words))
            word = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(n[word], pa.int64())], names=["word", "n"])

    out = np.zeros(len(words), np.int64)
    for row in in_batches(docs.select("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[row["word"]] = row["n"]
    return out


def index(templates: Sequence[tuple[str, str]], words: np.ndarray, counts: np.ndarray, percent: int) -> Index:
    """Tokens of each template by rising frequency (ties by hash). A block that holds ``percent`` of them holds one of the prefix."""
    rank = np.empty(len(words), np.int64)
    rank[np.lexsort((words, counts))] = np.arange(len(words))
    tokens, need, prefixes, lengths, bits = [], [], {}, [], []
    for k, (_, text) in enumerate(templates):
        whole = _places(_hashes(text), words)
        own = np.unique(whole)
        own = own[np.argsort(rank[own])]
        least = -(-percent * len(own) // 100)
        for at, word in enumerate(own[:len(own) - least + 1].tolist()):
            prefixes.setdefault(word, []).append((k, at))
        tokens.append(own)
        need.append(least)
        lengths.append(len(whole))
        number = np.arange(len(own))
        mask = np.zeros((len(words) + 1, -(-len(own) // 64)), np.uint64)
        mask[own, number // 64] = np.uint64(1) << (number % 64).astype(np.uint64)
        bits.append(mask)
    return Index(words, tuple(tokens), rank, tuple(label for label, _ in templates), prefixes, tuple(need), tuple(lengths), tuple(bits))


def match(block: np.ndarray, n_distinct: int, of: Index) -> Iterator[tuple[int, float]]:
    """Templates that a block holds enough of. ``block``: its words' places in the vocabulary; ``n_distinct``: of all its words."""
    own = np.unique(block)
    own = own[np.argsort(of.rank[own])]
    held, seen = set(own.tolist()), set()
    for q, word in enumerate(own.tolist()):
        for k, p in of.prefixes.get(word, ()):
            if k in seen:
                continue
            total, least = len(of.tokens[k]), of.need[k]
            if n_distinct < least:  # length
                continue
            if min(total - p, len(own) - q) < least:  # position: what both have from here on; nothing before was shared
                continue
            seen.add(k)
            shared = len(held.intersection(of.tokens[k].tolist()))
            if shared >= least:
                yield k, shared / total


def windows(place: np.ndarray, text: np.ndarray, first: np.ndarray, of: Index) -> Iterator[tuple[int, str, float]]:
    """Stretches of words, as many as a template has, that hold enough of it, wherever lines end: first shared word, label and share.

    Of stretches that overlap, the one that shares most is named. ``place``, ``text``: of each word of a batch; ``first``: of each text.
    """
    for k, least in enumerate(of.need):
        size, bits = of.lengths[k], of.bits[k]
        if not size:
            continue
        prefix = np.zeros(len(of.vocabulary) + 1, bool)
        prefix[of.tokens[k][:len(of.tokens[k]) - least + 1]] = True
        met = np.flatnonzero(prefix[place])
        begins, counts = [], []
        for c in range(0, len(met), CHUNK):
            at = met[c:c + CHUNK]
            low, high = first[text[at]], first[text[at] + 1]
            # Length and position: what stands around the word, within its text, must hold enough of the template's words.
            near = at[:, None] + np.arange(1 - size, size)
            inside = (near >= low[:, None]) & (near < high[:, None])
            known = bits[place[near.clip(0, len(place) - 1)]].any(axis=2) & inside
            enough = known.sum(axis=1) >= least
            at, low = at[enough], low[enough]
            begin = np.unique(np.maximum(at[:, None] - np.arange(size), low[:, None]))
            for b in range(0, len(begin), CHUNK):
                some = begin[b:b + CHUNK]
                shared = np.bitwise_count(np.bitwise_or.reduce(_masks(some, size, place, text, first, bits), axis=1)).sum(axis=1)
                begins.append(some[shared >= least])
                counts.append(shared[shared >= least])
        if not begins:
            continue
        begin, where = np.unique(np.concatenate(begins), return_index=True)
        shared = np.concatenate(counts)[where].astype(np.int64)
        taken = np.zeros(len(place), bool)
        for i in np.lexsort((begin, -shared)).tolist():
            b = int(begin[i])
            e = min(b + size, int(first[text[b] + 1]))
            if not (taken[b] or taken[e - 1]):
                taken[b:e] = True
                known = bits[place[b:e]].any(axis=1)
                yield b + int(known.argmax()), of.labels[k], int(shared[i]) / len(of.tokens[k])


def _masks(begin: np.ndarray, size: int, place: np.ndarray, text: np.ndarray, first: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Masks of the words of each stretch of ``size`` words; zeros beyond the text's end."""
    at = begin[:, None] + np.arange(size)
    out = bits[place[at.clip(0, len(place) - 1)]]
    out[at >= first[text[begin] + 1][:, None]] = 0
    return out


SCANS = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
         "blocks array<struct<line:long,label:string,share:double>>")


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, percent: int = 90) -> DataFrame:
    """License phrases and templates of each text.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, in lower case. Phrases: all places where their words
    follow each other. Templates: a block is a line or a paragraph (lines with words that follow each other) of at most LOOSE times as many words as the
    template, or a stretch of as many as the template has, across lines and paragraphs. ``blocks`` names each that holds ``percent`` of a template's distinct words, by the
    line of the first of them, with the share; the largest share if several have the same line and label, and a paragraph only if nothing
    in it has its share. A first pass counts, over the whole corpus, the lines with each word of a template; the words of templates, rarest first, give
    the prefixes that the second pass looks for. Templates are a parameter, so the index has a fixed size. score: the largest share, 1
    with a phrase, else 0. Null and empty texts have no words, no labels ('') and score 0. Repeated rows get a row each.
    """
    words = np.unique(np.concatenate([vocabulary(templates), *[_hashes(p) for p, _ in phrases]]))
    of = index(templates, words, frequencies(docs, words), percent)
    series = [(_places(_hashes(p), words), label) for p, label in phrases]
    starts = np.zeros(len(words), bool)
    starts[list(of.prefixes)] = True
    found_type = pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, line, text, first, top = scan_words(column(batch, "text"))
        n = batch.num_rows
        place = _places(hashes, words)
        n_base, low, high = np.zeros(n, np.int64), np.full(n, len(hashes) + 1), np.full(n, -1)
        base: list[set[str]] = [set() for _ in range(n)]
        for phrase, label in series:
            ends = len(place) - len(phrase) + 1
            ok = place[:max(ends, 0)] == phrase[0]
            for k in range(1, len(phrase)):
                ok &= place[k:k + len(ok)] == phrase[k]
            at = np.flatnonzero(ok)
            at = at[text[at] == text[at + len(phrase) - 1]]
            inside = at - first[text[at]]
            n_base += np.bincount(text[at], minlength=n)
            np.minimum.at(low, text[at], inside)
            np.maximum.at(high, text[at], inside)
            for i in np.unique(text[at]).tolist():
                base[i].add(label)
        shares: list[dict[tuple[int, str], float]] = [{} for _ in range(n)]

        def found(word: int, label: str, share: float) -> None:
            i = int(text[word])
            key = int(line[word]) - int(top[i]), label
            shares[i][key] = max(share, shares[i].get(key, 0.0))

        # A text's first line has a number of its own, so two lines of a paragraph are one apart and of the same text.
        edge = np.append(True, (line[1:] - line[:-1] > 1) | (text[1:] != text[:-1]))[:len(line)]
        paragraph = np.cumsum(edge)
        hit = (place >= 0) & starts[place]
        for word, label, share in windows(place, text, first, of):
            found(word, label, share)
        for group in (line, paragraph):
            for number in np.unique(group[hit]).tolist():
                b, e = (int(x) for x in (np.searchsorted(group, number), np.searchsorted(group, number, side="right")))
                begin, end = line[b], line[e - 1]
                if group is paragraph and begin == end:
                    continue
                own, i = place[b:e], int(text[b])
                for k, share in match(own[own >= 0], len(np.unique(hashes[b:e])), of):
                    if e - b > LOOSE * of.lengths[k]:
                        continue
                    # A paragraph is named only where no line or stretch of words in it says as much.
                    if group is line or not any(x == of.labels[k] and begin <= at + top[i] <= end and y >= share for (at, x), y in shares[i].items()):
                        found(b + int(of.bits[k][own].any(axis=1).argmax()), of.labels[k], share)
        blocks = [[{"line": at, "label": label, "share": share} for (at, label), share in sorted(x.items())] for x in shares]
        labels = [sorted(base[i] | {x["label"] for x in blocks[i]}) for i in range(n)]
        score = [1.0 if base[i] else max((x["share"] for x in blocks[i]), default=0.0) for i in range(n)]
        met = n_base > 0
        return pa.RecordBatch.from_arrays([
            column(batch, "doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(n_base, pa.int64()), pa.array(low, pa.int64(), mask=~met),
            pa.array(high, pa.int64(), mask=~met), pa.array([",".join(sorted(x)) for x in base], pa.string()),
            pa.array([",".join(x) for x in labels], pa.string()), pa.array(score, pa.float64()), pa.array(blocks, found_type)],
            names=[c.split()[0] for c in SCANS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield one(batch)

    return in_batches(docs.select("doc_id", "text")).mapInArrow(run, SCANS)
