def brute_components(pairs, nodes):
    at = {x: x for x in nodes}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        ra, rb = sorted((root(a), root(b)))
        at[rb] = ra
    return {x: root(x) for x in nodes}
