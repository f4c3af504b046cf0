"""Plain versions for small tables."""

import re


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_components(rows):
    own = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        own.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if own[i] and label[i] != label[j] and 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (doc, _), x in zip(rows, label, strict=True):
        least[x] = min(least.get(x, doc), doc)
    return [(doc, least[x]) for (doc, _), x in zip(rows, label, strict=True)]


def brute_hits(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall(lower(text))
    at = {}
    for n in {min(10, len(word.findall(lower(t)))) for _, t in items} - {0}:
        at[n] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    for _, t in items:
        x = word.findall(lower(t))
        n = min(10, len(x))
        if n and any(tuple(x[i : i + n]) in at[n] for i in range(len(x) - n + 1)):
            return True
    return False
