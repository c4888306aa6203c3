"""Plans: their text, and settings that steer them."""
