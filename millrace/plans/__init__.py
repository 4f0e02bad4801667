"""Named plans and their reference SQL."""
