"""sightline: what a sensor can and cannot see in scenes of tracked road users, as Spark DataFrame operators."""
