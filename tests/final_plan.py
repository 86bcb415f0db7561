"""What a query's plan came to, once it has run."""


def _children(node):
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if kind.endswith("QueryStageExec"):
        return [node.plan()]
    if kind == "ReusedExchangeExec":
        return [node.child()]
    below = node.children()
    return [below.apply(i) for i in range(below.size())]


def _walk(node):
    yield node
    for c in _children(node):
        yield from _walk(c)


def nested_loop_rows(df) -> list[int]:
    """The broadcast rows of each nested loop in the final plan of ``df``, which has been collected."""
    out = []
    for node in _walk(df._jdf.queryExecution().executedPlan()):
        if node.getClass().getSimpleName() == "BroadcastNestedLoopJoinExec":
            sides = [next(n for n in _walk(s)) for s in _children(node)]
            for side in sides:
                while side.getClass().getSimpleName() in ("BroadcastQueryStageExec", "ReusedExchangeExec", "InputAdapter"):
                    side = _children(side)[0]
                if side.getClass().getSimpleName() == "BroadcastExchangeExec":
                    out.append(side.metrics().apply("numOutputRows").value())
    return out
