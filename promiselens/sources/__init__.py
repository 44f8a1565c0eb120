"""Where tables come from: landed files, the test tables, fixed seed tables."""
