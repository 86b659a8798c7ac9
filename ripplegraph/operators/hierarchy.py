"""Types with all that is above them, and the methods that a call by name may mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators.graph import parent_closure
from ripplegraph.session import written

#: Methods that every class has from outside of the code base: fixed values.
OBJECT_METHODS = ("equals", "hashCode", "toString", "getClass", "notify", "notifyAll", "wait", "clone", "finalize")


def levels(types: DataFrame, supers: DataFrame) -> DataFrame:
    """id, above, distance: every type (id) with itself (0) and all that is above it over (id, parent)."""
    above = parent_closure(supers.select("id", "parent")).select("id", F.col("ancestor").alias("above"), "distance")
    return types.select("id", F.col("id").alias("above"), F.lit(0).alias("distance")).unionByName(above)


def outside(types: DataFrame, closure: DataFrame) -> DataFrame:
    """id: types the hierarchy of which leaves the code base. types: id, kind, extends (whether it names a superclass), external (whether a supertype it names is not in the code base);
    a class without a superclass and an enum have one outside."""
    own = types.filter(F.col("external") | ((F.col("kind") == "class") & ~F.col("extends")) | (F.col("kind") == "enum"))
    return closure.join(own.select(F.col("id").alias("above")), "above", "left_semi").select("id").distinct()


def method_candidates(calls: DataFrame, closure: DataFrame, beyond: DataFrame, methods: DataFrame) -> DataFrame:
    """call, method, strength, status of every call (call, type, name, arity; a null arity fits all).

    Candidates are the methods (id, owner, name, signature, params, varargs) of the type and of all above it with the name and a number of parameters that fits (with varargs one
    less is enough); of one signature the nearest, then the least id. One candidate is FOUND exactly (5); several are all FOUND, inferred (3). Without any a call is EXTERNAL where the
    hierarchy leaves the code base or every class has the method, else NOT_FOUND."""
    calls = written(calls.select("call", "type", "name", F.col("arity").cast("int").alias("arity")), "calls")
    # Whatever the call, of a type's methods of one name, signature and number of parameters only the nearest can be meant.
    own = methods.select(F.col("id").alias("method"), F.col("owner").alias("above"), "name", "signature", F.col("params").cast("int").alias("params"), "varargs")
    own = own.groupBy("above", "name", "signature", "params", "varargs").agg(F.min("method").alias("method"))
    fits = F.col("arity").isNull() | F.when(F.col("varargs"), F.col("arity") + 1 >= F.col("params")).otherwise(F.col("arity") == F.col("params"))
    nearest = lambda df, *key: df.groupBy(*key, "signature").agg(F.min(F.struct("distance", "method")).alias("x")).select(*key, "signature", "x.*")
    # What is meant is found once for each type, name and arity, the signatures of which a call gets as they are.
    asked = written(calls.select("type", "name", "arity").distinct(), "asked")
    there = asked.select("type", "name").distinct().join(closure.withColumnRenamed("id", "type"), "type").join(own, ["above", "name"])
    there = written(nearest(there, "type", "name", "params", "varargs"), "candidates")
    found = nearest(asked.join(there, ["type", "name"]).filter(fits), "type", "name", "arity")
    meant = written(found.groupBy("type", "name", "arity").agg(F.collect_list(F.struct("signature", "distance", "method")).alias("found")), "meant")
    same = [F.col("type") == F.col("_type"), F.col("name") == F.col("_name"), F.col("arity").eqNullSafe(F.col("_arity"))]
    told = calls.join(meant.select(F.col("type").alias("_type"), F.col("name").alias("_name"), F.col("arity").alias("_arity"), "found"), same, "left").select("call", "type", "name", "found")
    # A call that has several rows has the nearest of all of them.
    again = written(calls.groupBy("call").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("call"), "again")
    once = told
    if not again.isEmpty():
        once = told.join(again, "call", "left_anti")
        several = told.join(again, "call", "left_semi")
        each = nearest(several.select("call", F.inline("found")), "call").groupBy("call").agg(F.collect_list(F.struct("signature", "distance", "method")).alias("found"))
        rest = several.join(each.select("call"), "call", "left_anti")
        once = once.unionByName(each.select("call", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("name"), "found")).unionByName(rest)
    strength = F.when(F.size("found") > 1, 3).otherwise(5)
    leaves = beyond.select(F.col("id").alias("type"), F.lit(True).alias("leaves"))
    status = F.when(F.col("found").isNotNull(), "FOUND").when(F.coalesce("leaves", F.lit(False)) | F.col("name").isin(*OBJECT_METHODS), "EXTERNAL").otherwise("NOT_FOUND")
    out = once.join(leaves, "type", "left").select("call", F.when(F.col("found").isNotNull(), strength).alias("strength"), status.alias("status"), "found")
    return out.select("call", "strength", "status", F.explode_outer("found.method").alias("method")).select("call", "method", "strength", "status")
