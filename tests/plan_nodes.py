"""Nodes of a plan as it was run."""


def nodes(df):
    """All physical nodes after ``df`` has run, stages of adaptive execution included; what is reused counts once."""
    df.collect()
    found = []

    def walk(node):
        kind = node.getClass().getSimpleName()
        found.append((kind, node))
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "ReusedExchangeExec":
            return None
        children = node.children()
        for n in range(children.size()):
            walk(children.apply(n))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def columns(node):
    output = node.output()
    return [output.apply(n).name() for n in range(output.size())]


def exchanges(df, column):
    """Exchanges that move ``column``."""
    return [node for kind, node in nodes(df) if kind == "ShuffleExchangeExec" and column in columns(node)]


def scans(df, column):
    return [node for kind, node in nodes(df) if kind == "FileSourceScanExec" and column in columns(node)]
