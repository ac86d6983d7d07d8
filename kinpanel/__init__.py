"""Study cohorts, person-year panels and life events from registers, on Spark."""
