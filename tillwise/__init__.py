"""Shop analytics as DataFrame operators: raw shop tables in, named result tables out."""
