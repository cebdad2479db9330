x = 1
 