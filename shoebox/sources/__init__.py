"""Sources: file listing, EXIF reading, previews, image signals."""
