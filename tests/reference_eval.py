"""A plain evaluator for tests: backtracking over small fact lists, no Spark.

It follows the decisions recorded in the survey: patterns first, then groups in
order with ``not`` after the groups that bind its variables, an unbound shared
variable matching anything, and sorting with nulls last.
"""

from quillfact.functions.values import comparable
from quillfact.plans import ast as A


class Failed(Exception):
    pass


def bind(pattern, facts, env):
    for args in facts.get(pattern.predicate, ()):
        if len(args) != len(pattern.args):
            continue
        new, ok = dict(env), True
        for t, v in zip(pattern.args, args):
            if isinstance(t, A.Lit):
                ok = t.value == v
            elif isinstance(t, A.Var):
                if new.get(t.name) is None:
                    new[t.name] = v
                else:
                    ok = new[t.name] == v
            if not ok:
                break
        if ok:
            yield new


def holds(clause, env):
    def value(t):
        if isinstance(t, A.Lit):
            return t.value
        if not isinstance(t, A.Var) or env.get(t.name) is None:
            raise Failed("unbound")
        return env[t.name]

    def test(x, op, y):
        a, b = value(x), value(y)
        if op == "=":
            return a == b
        if op == "!=":
            return a != b
        if not comparable(a.type, b.type):
            raise Failed("types")
        return {"<": a.order < b.order, "<=": a.order <= b.order, ">": a.order > b.order, ">=": a.order >= b.order}[op]

    if isinstance(clause, A.Compare):
        return test(clause.left, clause.op, clause.right)
    return test(clause.value, ">=", clause.low) and test(clause.value, "<=", clause.high)


def run(clauses, facts, env):
    """All bindings of a clause list that extend env."""
    envs = [env]
    for c in clauses:
        if isinstance(c, A.Pattern):
            envs = [n for e in envs for n in bind(c, facts, e)]
    for g in groups(clauses):
        out = []
        for e in envs:
            if isinstance(g, A.Either):
                out += [n for b in g.branches for n in run(b, facts, e)]
            elif isinstance(g, A.Optional_):
                out += run(g.body, facts, e) or [e]
            elif g.body and not run(g.body, facts, e):
                out.append(e)
        envs = out
    tests = A.filters(clauses)
    return [e for e in envs if all(holds(f, e) for f in tests)]


def groups(clauses):
    gs = [c for c in clauses if A.is_group(c)]
    late = lambda k: max([k, *[j for j, g in enumerate(gs) if not isinstance(g, A.Not_) and set(A.names([g])) & set(A.names([gs[k]]))]])
    return [gs[k] for k in sorted(range(len(gs)), key=lambda k: (late(k) if isinstance(gs[k], A.Not_) else k, isinstance(gs[k], A.Not_), k))]
