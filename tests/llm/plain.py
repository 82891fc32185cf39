"""Plain numpy versions of the quality classifier and of the quality rules' fit."""

import zlib

import numpy as np

from spanloom.llm import quality_classifier, quality_rules

from . import brute


def _counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word, capitals, exclamation marks."""
    lines = sum(bool(brute.WORD.search(x)) for x in text.split("\n"))
    return *brute.base(text), lines, sum("A" <= c <= "Z" for c in text), text.count("!")


def rules_vector(text):
    n, chars, symbols, dup_lines, _, lines, capitals, bangs = _counts(text)
    return [np.sqrt(symbols / (chars + 100)), np.log((chars + 300) / (n + 50)), np.sqrt(dup_lines / (lines + 10)), np.sqrt(capitals / (chars + 100)), np.sqrt(bangs / (chars + 100))]


def classifier_vector(text):
    n, chars, symbols, dup_lines, repeats, lines, capitals, bangs = _counts(text)
    w = brute.words(text)
    same = sum(a == b for a, b in zip(w, w[1:], strict=False))
    a, b, c, d, e, f = np.sqrt([symbols / (chars + 20), bangs / (chars + 20), capitals / (chars + 50), same / (n + 20), dup_lines / (lines + 5), repeats / (n + 50)])
    return [a, b, c, d, np.log((len(set(w)) + 10) / (n + 10)), e, np.log((chars + 100) / (n + 20)), f]


def scores(docs, quality):
    """The calibrated quadratic discriminant of (doc_id, text), learned from labels outside the held-out fold."""
    q = quality_classifier
    x = np.array([classifier_vector(t) for _, t in docs])
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i, _ in docs])
    y = np.array([quality.get(i, -1) for i, _ in docs])
    known = [x[(fold != 0) & (y == k)] for k in (0, 1)]
    covariances = [np.cov(k.T, bias=True) for k in known]
    sizes = np.array([len(k) for k in known])
    pooled = (sizes[:, None, None] * covariances).sum(axis=0) / sizes.sum()
    logs = []
    for k, cov in zip(known, covariances, strict=True):
        cov = (1 - q.SHRINK) * cov + q.SHRINK * np.diag(np.diag(pooled)) + q.FLOOR**2 * np.eye(q.SIZE)
        away = x - k.mean(axis=0)
        logs.append(-0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away))
    z = np.clip(logs[1] - logs[0], -q.BOUND, q.BOUND)
    fitted = (fold != 0) & (y >= 0)
    at = np.round(z[fitted] / q.STEP) * q.STEP
    target = np.where(y[fitted] == 1, (sizes[1] + 1) / (sizes[1] + 2), 1 / (sizes[0] + 2))
    design = np.stack([at, np.ones_like(at)], axis=1)
    w = np.array([0.1, np.log(sizes[1] / sizes[0])])
    for _ in range(500):
        p = 1 / (1 + np.exp(-design @ w))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (p - target) + 1e-3 * w)
        w = w - step * min(1, 1 / np.abs(step).max())
    return 1 / (1 + np.exp(-(w[0] * z + w[1])))


def distances(x, langs, sources):
    """Minimum covariance determinants by concentration steps on whole sorted distances: each language's, and each source's with PRIOR rows of its language's core."""
    q = quality_rules
    floors, k = np.array(q.FLOORS), q.PRIOR
    langs, sources = np.array(langs), np.array(sources)

    def start(y):
        middle = np.median(y, axis=0)
        return middle, np.diag(np.maximum(np.median(abs(y - middle), axis=0) * 1.4826, floors) ** 2)

    def squares(y, estimate):
        mean, cov = estimate
        return np.einsum("ij,jk,ik->i", y - mean, np.linalg.inv(cov), y - mean)

    def core(y, estimate):
        d = squares(y, estimate)
        some = y[np.argsort(d, kind="stable")[: int(np.ceil(q.CORE * len(y)))]]
        return len(some), some.sum(axis=0), some.T @ some, np.median(d) / q.CHI2_MEDIAN

    def moments(n, sums, products):
        mean = sums / n
        return mean, products / n - np.outer(mean, mean) + np.diag(floors**2)

    wholes = {lang: x[langs == lang] for lang in set(langs)}
    groups = {(lang, s): x[(langs == lang) & (sources == s)] for lang, s in set(zip(langs.tolist(), sources.tolist(), strict=True))}
    of_lang = {lang: start(y) for lang, y in wholes.items()}
    now = {(*g, own): start(y) if own else of_lang[g[0]] for g, y in groups.items() for own in (True, False)}
    before = {}
    for _ in range(q.STEPS):
        lent = {lang: core(y, of_lang[lang]) for lang, y in wholes.items()}
        after = {}
        for (lang, s, own), estimate in now.items():
            n, sums, products, unit = lent[lang]
            m, t, p, u = core(groups[lang, s], estimate)
            size = len(groups[lang, s])
            after[lang, s, own] = (moments(m + k, t + k * sums / n, p + k * products / n), (size * u + k * unit) / (size + k), estimate)
        of_lang = {lang: moments(*v[:3]) for lang, v in lent.items()}
        now = {key: v[0] for key, v in after.items()}
        dets = {key: np.linalg.slogdet(cov)[1] for key, (_, cov) in [*now.items(), *of_lang.items()]}
        if before and max(abs(dets[key] - before[key]) for key in dets) <= q.TOLERANCE:
            break
        before = dets
    out = np.zeros(len(x))
    for (lang, s), y in groups.items():
        _, unit, estimate = min((after[lang, s, own] for own in (True, False)), key=lambda v: np.linalg.slogdet(v[0][1])[1])
        out[(langs == lang) & (sources == s)] = squares(y, estimate) / max(q.LEAST_SCALE, unit)
    return out


def kept_by_rules(rows):
    """Ids of (doc_id, text, lang, source) that pass the base rules and the fit."""
    fine = [r for r in rows if (b := brute.base(r[1]))[0] >= quality_rules.LEAST_WORDS and 100 * b[4] <= quality_rules.REPEAT_PERCENT * b[0]]
    d = distances(np.array([rules_vector(r[1]) for r in fine]), [r[2] for r in fine], [r[3] for r in fine])
    return {r[0] for r, x in zip(fine, d, strict=True) if x <= quality_rules.CUTOFF}
