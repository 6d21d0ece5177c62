"""From a query to a plan: names resolved, axes listed, measures fetched by grain."""
