"""Where pages, tables, images, answers and components come from."""
