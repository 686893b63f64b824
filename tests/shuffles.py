"""What a function's jobs shuffle."""


def written(spark, run):
    """Rows that a function's jobs shuffle where joins don't broadcast."""
    sc, small = spark.sparkContext, "spark.sql.autoBroadcastJoinThreshold"

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before, kept = total(), spark.conf.get(small)
    spark.conf.set(small, -1)
    run()
    spark.conf.set(small, kept)
    return total() - before
