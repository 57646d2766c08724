"""What executions made and wrote, by the metrics that Spark keeps of them."""


def last_execution(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    done = spark._jsparkSession.sharedState().statusStore().executionsList()
    return max((done.apply(i).executionId() for i in range(done.size())), default=-1)


def total(spark, after, node, metric, of=""):
    """The sum of a metric over nodes of that name whose description has a text, in the executions after one."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, found = spark._jsparkSession.sharedState().statusStore(), 0
    done = store.executionsList()
    for key in (done.apply(i).executionId() for i in range(done.size())):
        if key <= after:
            continue
        made, nodes = store.executionMetrics(key), store.planGraph(key).allNodes()
        for x in (nodes.apply(j) for j in range(nodes.size())):
            if node in x.name() and of in x.desc():
                own = [x.metrics().apply(m) for m in range(x.metrics().size())]
                got = [made.get(m.accumulatorId()) for m in own if m.name() == metric]
                found += sum(int(v.get().replace(",", "")) for v in got if v.isDefined())
    return found
