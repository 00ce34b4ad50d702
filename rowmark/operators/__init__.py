"""Table operators: views, labels, annotations, merge, summary."""
