"""Louvain's method and Kosaraju's in plain Python: what the joins' results are held against."""

from collections import Counter, defaultdict, deque


def modularity(groups, pairs, resolution=1.0):
    """pairs: (a, b, weight); groups: node to group."""
    total, inside, strength = 0.0, 0.0, Counter()
    for a, b, w in pairs:
        total += w
        inside += w * (groups[a] == groups[b])
        strength[groups[a]] += w
        strength[groups[b]] += w
    return inside / total - resolution * sum((s / (2 * total)) ** 2 for s in strength.values())


def louvain(pairs, resolution=1.0):
    names = sorted({x for a, b, _ in pairs for x in (a, b)})
    at = {x: i for i, x in enumerate(names)}
    links, strength = [defaultdict(float) for _ in names], [0.0] * len(names)
    for a, b, w in pairs:
        i, j = at[a], at[b]
        strength[i] += w
        strength[j] += w
        if i != j:
            links[i][j] += w
            links[j][i] += w
    total, where = sum(strength), list(range(len(names)))
    while True:
        group, held, todo = list(range(len(links))), list(strength), deque(range(len(links)))
        while todo:
            v = todo.popleft()
            into = Counter({group[v]: 0.0})
            for u, w in links[v].items():
                into[group[u]] += w
            held[group[v]] -= strength[v]
            best = max(into, key=lambda g: (round(into[g] - resolution * strength[v] * held[g] / total, 12), g == group[v], -g))
            held[best] += strength[v]
            if best != group[v]:
                group[v] = best
                todo.extend(u for u in sorted(links[v]) if group[u] != best and u not in todo)
        rank = {g: k for k, g in enumerate(dict.fromkeys(group))}
        if len(rank) == len(links):
            return {x: where[i] for x, i in at.items()}
        where = [rank[group[v]] for v in where]
        merged, summed = [defaultdict(float) for _ in rank], [0.0] * len(rank)
        for v, near in enumerate(links):
            summed[rank[group[v]]] += strength[v]
            for u, w in near.items():
                if rank[group[u]] != rank[group[v]]:
                    merged[rank[group[v]]][rank[group[u]]] += w
        links, strength = merged, summed


def strong_groups(pairs):
    """{node: smallest id of its group} for nodes on a directed cycle."""
    out, into, loops = defaultdict(list), defaultdict(list), {a for a, b in pairs if a == b}
    for a, b in pairs:
        out[a].append(b)
        into[b].append(a)
    done, order = set(), []
    for root in sorted(set(out) | set(into)):
        stack = [(root, iter(out[root]))] if root not in done else []
        done.add(root)
        while stack:
            x, rest = stack[-1]
            y = next((y for y in rest if y not in done), None)
            if y is None:
                order.append(x)
                stack.pop()
            else:
                done.add(y)
                stack.append((y, iter(out[y])))
    got, seen = {}, set()
    for root in reversed(order):
        group, todo = [], [root] if root not in seen else []
        seen.add(root)
        while todo:
            x = todo.pop()
            group.append(x)
            for y in into[x]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        if len(group) > 1 or group and group[0] in loops:
            got |= dict.fromkeys(group, min(group))
    return got
