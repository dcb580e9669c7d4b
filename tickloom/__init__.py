"""Market data tables and ticks on Spark: normalise, gate, publish, analyse."""
