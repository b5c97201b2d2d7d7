"""loomgraph: property-graph, rule and corpus analytics as Spark DataFrame programs."""
