"""Shared by the tests of the training-data operators."""


def components(n, links):
    """Smallest place reachable from each of n places."""
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return [top(i) for i in range(n)]


def stretches(chunks, min_words):
    """First byte, end and words of runs of neighbouring (place, extent) with enough words."""
    run = []

    def close():
        words = sum(e & 4095 for _, e in run)
        if run and words >= min_words:
            yield run[0][0] & ((1 << 40) - 1), (run[-1][0] & ((1 << 40) - 1)) + (run[-1][1] >> 12), words

    for chunk in sorted(chunks):
        if run and chunk[0] >> 40 != (run[-1][0] >> 40) + 1:
            yield from close()
            run = []
        run.append(chunk)
    yield from close()
