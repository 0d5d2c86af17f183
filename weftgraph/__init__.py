"""weftgraph: a property-graph and document analytics engine made of Spark DataFrames."""
